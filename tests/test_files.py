"""Files through to results and a report; charts by boxes and by nearness."""

import pathlib
import zipfile

import numpy as np
from pyspark.sql import functions as F

from cotejo import __main__ as command
from cotejo import config
from cotejo.operators import connectors, hierarchy, proximity
from cotejo.plans import files, report
from cotejo.plans.saved import shared_folder
from cotejo.sources import office
from tests.test_office import W, workbook

BOX = "x0 double, y0 double, x1 double, y1 double"


def inline(cells):
    return [(ref, "inlineStr", v) for ref, v in cells.items()]


def document(path, rows):
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in rows) + "</w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{table}</w:body></w:document>")


def chart(spark, folder, n_pages=1):
    """A superior with two under it, on each page, and a caption."""
    pages = [("o.pdf", p, 400.0) for p in range(1, n_pages + 1)]
    boxes = [(100.0, 0.0, 180.0, 40.0), (0.0, 100.0, 80.0, 140.0), (200.0, 100.0, 280.0, 140.0)]
    texts = ["Dirección General 45", "Enlace de Compras 21", "Enlace de Ventas 21"]
    lines = [(140.0, 40.0, 140.0, 70.0), (40.0, 70.0, 240.0, 70.0), (40.0, 70.0, 40.0, 100.0), (240.0, 70.0, 240.0, 100.0)]
    each = [p for _, p, _ in pages]
    spark.createDataFrame(pages, "file string, page int, height double").write.parquet(f"{folder}/pages")
    spark.createDataFrame([("o.pdf", p, 9 - i, *b) for p in each for i, b in enumerate(boxes)], f"file string, page int, rect_no long, {BOX}").write.parquet(f"{folder}/rects")
    spark.createDataFrame([("o.pdf", p, i, t, b[0] + 5, b[1] + 5, b[2] - 5, b[3] - 5) for p in each for i, (t, b) in enumerate(zip(texts, boxes, strict=True))], f"file string, page int, line long, text string, {BOX}").write.parquet(f"{folder}/lines")
    spark.createDataFrame([("o.pdf", p, i, *s, "line") for p in each for i, s in enumerate(lines)], f"file string, page int, seg long, {BOX}, kind string").write.parquet(f"{folder}/segments")


GRID = {"I1": "ID", "J1": "Puesto", "K1": "Nivel", "L1": "Jefe inmediato", "I2": "1", "J2": "Dirección General", "K2": "45", "I3": "2", "J3": "Enlace de Compras", "K3": "21", "L3": "1", "I4": "3", "J4": "Enlace de Ventas", "K4": "21"}
DOC = [("Cantidad", "Puesto", "Nivel"), ("1", "Dirección General", "45"), ("1", "Enlace de Compras", "21"), ("1", "Enlace de Ventas", "21")]


def test_command_by_id(spark, tmp_path, capsys):
    workbook(tmp_path / "r.xlsx", inline(GRID), ["L3:L4"])
    document(tmp_path / "d.docx", DOC)
    chart(spark, tmp_path / "chart")
    out = tmp_path / "out.xlsx"
    assert command.main(["--excel", str(tmp_path / "r.xlsx"), "--word", str(tmp_path / "d.docx"), "--organigrama", str(tmp_path / "chart"), "--salida", str(out), "--bitacora", str(tmp_path / "log.txt")]) == 0
    assert "3 results" in capsys.readouterr().out
    cells = [(r.sheet, r.sheet_no, r.row, r.col, r.value) for r in office.read_workbooks(spark, str(out)).where("kind = 'cell'").collect()]
    heads = {col: v for name, _, row, col, v in cells if name == "Detalle" and row == 1}
    found = {}
    for name, _, row, col, v in cells:
        if name == "Detalle" and row > 1:
            found.setdefault(row, {})[heads[col]] = v
    assert len(heads) == 41 and len(found) == 3
    assert {r["Resultado de orden"] for r in found.values()} == {config.SAME}
    lines = {}
    for name, _, row, col, v in cells:
        if name == "Resumen":
            lines.setdefault(row, []).append((col, v))
    lines = {row: [v for _, v in sorted(vs)] for row, vs in lines.items()}
    assert lines[1] == [report.TITLE] and lines[4] == report.HEADS[0] and lines[5] == ["Total de puestos esperados (Excel)", "3"]
    assert lines[22] == report.HEADS[1] and lines[23] == [config.OK, "3"] and lines[25] == [report.BY_SOURCE] and lines[26] == report.HEADS[2]
    assert [lines[i] for i in (27, 28, 29)] == [[s, "3", "3", "3", "0", "0"] for s in ("Excel", "Word", "Organigrama")]
    assert "3 registro(s)" in (tmp_path / "log.txt").read_text() and not list(pathlib.Path(shared_folder(spark).removeprefix("file:")).glob("run-*"))


def test_positions_of_files(spark, tmp_path):
    workbook(tmp_path / "r.xlsx", inline(GRID | {"I4": "2", "J5": "Asesor", "K5": "43", "L5": "7"}), ["L3:L4"])
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    rows = {r.puesto_original: r for r in files.excel_positions(spark, str(tmp_path)).collect()}
    assert rows[""].error.startswith(files.BAD_WORKBOOK) and len(rows) == 5
    assert rows["Enlace de Ventas"].jefe_inmediato == "Dirección General"  # the merged cell has no value of its own
    assert rows["Asesor"].error_id == files.BAD_ID and rows["Asesor"].jefe_inmediato == "[ID de jefe no resoluble: 7]"
    assert rows["Enlace de Compras"].error_id == f"{files.REPEATED_ID}2." and rows["Dirección General"].error_id == ""
    assert rows["Dirección General"].ubicacion == "r.xlsx | hoja='Hoja' | fila=2 | col=J/K"
    document(tmp_path / "d.docx", DOC)
    (tmp_path / "e.docx").write_bytes(b"no zip")
    got = files.word_positions(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.puesto_original for r in got] == ["Dirección General", "Enlace de Compras", "Enlace de Ventas", ""] and got[3].error.startswith(files.BAD_DOCUMENT)
    assert files.word_positions(spark, "x.pdf").first().error == files.NO_PDF
    try:
        files.word_positions(spark, "x.odt")
        raise AssertionError
    except ValueError as e:
        assert ".odt" in str(e)


def test_by_name_without_documents(spark, tmp_path):
    workbook(tmp_path / "r.xlsx", inline({k.replace("I", "B") if k[0] == "I" else k: v for k, v in GRID.items()}))
    chart(spark, tmp_path / "chart")
    excel = files.excel_positions(spark, str(tmp_path / "r.xlsx"))
    results = files.compare(excel, None, files.read_chart(spark, str(tmp_path / "chart")))
    assert {r.kind for r in results.select("kind").collect()} == {config.OK} and results.count() == 3
    rows = report.rows(results, False)
    assert len(rows.columns) == 33
    assert report.filtered(rows, search="VENTAS").count() == 1 and report.filtered(rows, [config.EXTRA]).count() == 0 and report.filtered(rows, open_names=True).count() == 0


def test_chart_of_several_pages(spark, tmp_path):
    chart(spark, tmp_path / "chart", 2)
    rows = files.read_chart(spark, str(tmp_path / "chart")).orderBy("seq").collect()
    assert [r.puesto_original for r in rows] == ["Dirección General", "Enlace de Compras", "Enlace de Ventas"] * 2
    assert all(r.posicion_lectura is None and "varias páginas" in r.error_orden for r in rows)
    assert rows[1].jefe_inmediato == "Dirección General" and rows[1].nivel_original == "21"


def test_no_table_of_a_chart_goes_through_the_driver(spark, tmp_path, monkeypatch):
    """However small its files are: Spark sends tables whose files have up to 10 MB to every executor, and these hold hundreds of MB of rows."""
    plans = []
    told = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())
    for module in (files, hierarchy, connectors):
        monkeypatch.setattr(module, "saved", lambda df, saved=module.saved: told(df) or saved(df))
    monkeypatch.setattr(files, "global_order", lambda df, by, name: told(df) or df.withColumn(name, F.lit(0)))
    chart(spark, tmp_path / "chart", 2)
    assert files.read_chart(spark, str(tmp_path / "chart")).count() == 6
    assert sum(p.count("SortMergeJoin") for p in plans) > 30 and not [p for p in plans if "Broadcast" in p]


def walk(boxes, margin):
    """Clusters by passes over the free boxes until a pass adds none."""
    free, out = list(range(len(boxes))), []
    while free:
        group = [free.pop(0)]
        edge = list(boxes[group[0]])
        while True:
            before = len(group)
            for j in list(free):
                b = boxes[j]
                if -3 * margin <= b[1] - edge[3] <= margin and b[2] >= edge[0] - 4 * margin and b[0] <= edge[2] + 4 * margin:
                    free.remove(j)
                    group.append(j)
                    edge = [min(edge[0], b[0]), min(edge[1], b[1]), max(edge[2], b[2]), max(edge[3], b[3])]
            if len(group) == before:
                break
        out.append(group)
    return out


def test_clusters_follow_the_walk():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 9, 40):
        for _ in range(40):
            corner = rng.integers(0, 200, (n, 2)).astype(float)
            boxes = np.hstack([corner, corner + rng.integers(1, 40, (n, 2))])
            boxes = boxes[np.lexsort((boxes[:, 0], boxes[:, 1]))]
            label, joined = proximity.clusters(boxes, 6.0)
            got = [sorted(np.flatnonzero(label == first), key=lambda i: joined[i]) for first in sorted(set(label))]
            assert got == walk(boxes, 6.0)


def test_proximity_records(spark):
    rows = [("f", 1, 0, "Enlace de", 0.0, 0.0, 50.0, 10.0), ("f", 1, 1, "Compras\nNivel 21", 0.0, 12.0, 50.0, 20.0), ("f", 1, 2, "Organigrama", 300.0, 0.0, 350.0, 10.0), ("f", 1, 3, "Asesor 2024 43", 0.0, 200.0, 50.0, 210.0), ("f", 1, 4, None, 0.0, 300.0, 5.0, 305.0), ("f", 1, 5, "Página 3", 0.0, 390.0, 5.0, 395.0)]
    blocks = spark.createDataFrame(rows, f"file string, page int, line long, text string, {BOX}")
    pages = spark.createDataFrame([("f", 1, 400.0)], "file string, page int, height double")
    got = {r.title: r.level for r in proximity.proximity_records(blocks, pages).collect()}
    assert got == {"Enlace de Compras": "Nivel 21", "Asesor 2024": "43"}
    assert proximity.proximity_records(blocks.limit(0), pages).count() == 0
    assert proximity.proximity_records(blocks.withColumn("text", F.lit(None).cast("string")), pages).count() == 0
