"""Readers on files built here, and through to records."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cotejo.operators import cells
from cotejo.sources import office
from cotejo.sources import workbook as workbook_target

X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, grid, merged=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {X} xmlns:r="{R}"><sheets><sheet name="Hoja" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {X}><si><t>Puesto</t></si><si><r><t>Ni</t></r><r><t>vel</t></r></si></sst>")
        body = "".join(f'<c r="{ref}" t="{kind}">' + (f"<is><t>{v}</t></is>" if kind == "inlineStr" else f"<v>{v}</v>") + "</c>" for ref, kind, v in grid)
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {X}><sheetData><row>{body}</row></sheetData><mergeCells>{"".join(f"<mergeCell ref=%s/>" % repr(m) for m in merged)}</mergeCells></worksheet>')


def test_workbook(spark, tmp_path):
    grid = [("J1", "s", "0"), ("K1", "s", "1"), ("L1", "inlineStr", "Jefe inmediato"), ("J2", "inlineStr", "Enlace"), ("K2", "n", "20"), ("L2", "inlineStr", "Titular"), ("J3", "inlineStr", "Asesor"), ("K3", "n", "43"), ("L3", "inlineStr", " "), ("I2", "b", "1")]
    workbook(tmp_path / "a.xlsx", grid, ["L2:L3"])
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_text("other")
    found = office.read_workbooks(spark, str(tmp_path))
    assert found.where("error IS NOT NULL").count() == 1 and found.where("value = 'True'").count() == 1
    assert found.where("kind = 'merged'").select("row", "col", "last_row", "last_col").first() == (2, 12, 3, 12)
    merged = found.where("kind = 'merged'").selectExpr("file", "sheet", "row AS min_row", "last_row AS max_row", "col AS min_col", "last_col AS max_col")
    filled = cells.fill_merged(found.where("kind = 'cell'"), merged)
    rows = cells.records(filled).orderBy("row").collect()
    assert [(r.puesto_original, r.nivel_original, r.jefe_text) for r in rows] == [("Enlace", "20", "Titular"), ("Asesor", "43", "Titular")]
    assert office.read_workbooks(spark, str(tmp_path), "Hoja").where("kind = 'cell'").count() == len(grid)
    with pytest.raises(ValueError, match="Análisis incompleto"):
        office.read_workbooks(spark, str(tmp_path), "Otra")
    assert office.place("BC12") == (12, 55)


def test_document(spark, tmp_path):
    cell = lambda *p: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in p) + "</w:tc>"
    row = lambda *c: "<w:tr>" + "".join(c) + "</w:tr>"
    table = "<w:tbl>" + row(cell("Cantidad"), cell("Puesto"), cell("Nivel")) + row(cell("1"), cell("Enlace", "de X"), cell("20")) + "</w:tbl>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{table}</w:body></w:document>")
    (tmp_path / "e.docx").write_bytes(b"no zip")
    rows = office.read_doc_rows(spark, str(tmp_path))
    assert rows.where("error IS NOT NULL").count() == 1
    got = cells.table_records(rows.where("error IS NULL").drop("error")).first()
    assert (got.puesto_original, got.nivel_original, got.cantidad) == ("Enlace\nde X", "20", "1")


def cell(*paragraphs, about="", inside=""):
    return f"<w:tc><w:tcPr>{about}</w:tcPr>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs) + inside + "</w:tc>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(r) + "</w:tr>" for r in rows) + "</w:tbl>"


def document(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}<w:sectPr/></w:body></w:document>")


def test_merged_and_nested_cells(spark, tmp_path):
    """A cell over two columns stands in both, one that goes on downwards in each row; a table in a cell is no table of the document, nor its text the cell's."""
    span = lambda n: f'<w:gridSpan w:val="{n}"/>'
    down = lambda x: f'<w:vMerge w:val="{x}"/>' if x else "<w:vMerge/>"
    head = [cell("Cantidad"), cell("Puesto"), cell("Nivel")]
    nested = table([cell("Puesto"), cell("Nivel")], [cell("Dentro"), cell("40")])
    body = table(head, [cell("Enlace A", about=span(2)), cell("21")], [cell("1"), cell("Enlace B", about=down("restart")), cell("20")], [cell("2"), cell("", about=down("")), cell("21")], [cell("3"), cell("Enlace C", inside=nested), cell("20")])
    document(tmp_path / "d.docx", f"<w:p><w:r><w:t>Text</w:t></w:r></w:p>{body}<w:p/>" + table(head, [cell("1"), cell("Asesor"), cell("43")]))
    rows = office.read_doc_rows(spark, str(tmp_path)).orderBy("table_idx", "row_idx").collect()
    assert [list(r.cells) for r in rows if r.table_idx == 0] == [["Cantidad", "Puesto", "Nivel"], ["Enlace A", "Enlace A", "21"], ["1", "Enlace B", "20"], ["2", "Enlace B", "21"], ["3", "Enlace C", "20"]]
    assert [(r.table_idx, r.row_idx) for r in rows if r.table_idx] == [(1, 1), (1, 2)]


def test_damaged_files(spark, tmp_path):
    """A byte that is flipped anywhere costs its file alone, and leaves one row that says so or the file as it was."""
    grid = [(f"{c}{r}", "inlineStr", f"{c} of row {r}") for r in range(1, 200) for c in "JK"]
    with zipfile.ZipFile(tmp_path / "good.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        workbook(tmp_path / "plain.zip", grid)
        with zipfile.ZipFile(tmp_path / "plain.zip") as plain:
            for name in plain.namelist():
                z.writestr(name, plain.read(name))
    good = (tmp_path / "good.xlsx").read_bytes()
    for i in range(0, len(good), max(1, len(good) // 40)):
        (tmp_path / f"bad{i}.xlsx").write_bytes(good[:i] + bytes([good[i] ^ 0x55]) + good[i + 1 :])
    (tmp_path / "cut.xlsx").write_bytes(good[: len(good) // 2])
    (tmp_path / "empty.xlsx").write_bytes(b"")
    by_file = {}
    for r in office.read_workbooks(spark, str(tmp_path)).collect():
        by_file.setdefault(r.file.rpartition("/")[2], []).append(r)
    assert sum(r.kind == "cell" for r in by_file["good.xlsx"]) == len(grid) and len(by_file) > 40
    for name, rows in by_file.items():
        assert [r.kind for r in rows] == ["error"] and rows[0].error or sum(r.kind == "cell" for r in rows) == len(grid), name
    assert sum(rows[0].kind == "error" for rows in by_file.values()) > 20
    for bad in (b"no zip", good[:99]):
        (tmp_path / "w.docx").write_bytes(bad)
        assert office.read_doc_rows(spark, str(tmp_path)).collect()[0].error


def test_cells_without_reference_and_filters(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {X} xmlns:r="{R}"><sheets><sheet name="Uno" r:id="r1"/><sheet name="Dos" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="/xl/worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {X}><sheetData><row><c><v>1</v></c><c><v>2</v></c></row><row r='5'><c r='C5'><v>3</v></c><c><v>4</v></c></row><row><c t='b'><v>0</v></c></row></sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {X}><sheetData/></worksheet>")
    rows = office.read_workbooks(spark, str(tmp_path))
    assert sorted((r.row, r.col, r.value) for r in rows.where("kind = 'cell'").collect()) == [(1, 1, "1"), (1, 2, "2"), (5, 3, "3"), (5, 4, "4"), (6, 1, "False")]
    assert [r.sheet for r in rows.where("kind = 'sheet'").orderBy("sheet_no").collect()] == ["Uno", "Dos"]
    read = spark.read.format("workbook_rows").load(str(tmp_path))
    assert read.where("sheet = 'Uno' AND col IN (3, 4)").count() == 2 and read.where("kind = 'sheet'").count() == 2
    reader = office.WorkbookReader({"path": str(tmp_path)})
    list(reader.pushFilters([office.EqualTo(("sheet",), "Uno"), office.In(("col",), (3, 4))]))
    assert sum(r[3] == "cell" for p in reader.partitions() for r in reader.read(p)) == 2


def test_a_partition_for_each_sheet(tmp_path, monkeypatch):
    for name in ("a", "b"):
        workbook(tmp_path / f"{name}.xlsx", [("A1", "n", "1")])
    assert [p.paths for p in office.WorkbookReader({"path": str(tmp_path)}).partitions()] == [[str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx")]]
    monkeypatch.setattr(office, "SHARED_BYTES", 10)
    assert [(p.paths, p.sheet_no) for p in office.WorkbookReader({"path": str(tmp_path)}).partitions()] == [([str(tmp_path / f"{n}.xlsx")], 0) for n in "ab"]


def test_workbook_writer(spark, tmp_path):
    """All or nothing, styles, several files, and what a sheet can't hold."""
    workbook_target.register(spark)
    frame = spark.createDataFrame([(i, f"t<{i}>&", None if i % 2 else 1.5, "FFC7CE") for i in range(10)], "n int, t string, v double, c string")
    out = tmp_path / "out"
    frame.repartition(3).write.format("workbook").mode("overwrite").options(colour="c", sheet="Hoja <1>").save(str(out))
    back = office.read_workbooks(spark, str(out))
    assert back.where("kind = 'sheet'").count() == 3 and back.where("error IS NOT NULL").count() == 0
    assert back.where("kind = 'cell' AND value LIKE 't<%'").count() == 10 and back.where("kind = 'cell' AND col = 4").count() == 0
    one = tmp_path / "one.xlsx"
    frame.coalesce(1).write.format("workbook").mode("overwrite").options(colour="c", summary='[["title", ["A", 1]], ["", []], ["bold", ["B"]]]').save(str(one))
    with zipfile.ZipFile(one) as z:
        sheet, styles = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/styles.xml").decode()
        assert 'state="frozen"' in sheet and '<autoFilter ref="A1:C11"/>' in sheet and 'customWidth="1"' in sheet and "FFFFC7CE" in styles and "FF44546A" in styles
        assert z.testzip() is None and b'<v>1</v>' in z.read("xl/worksheets/sheet2.xml")
    before = one.read_bytes()
    broken = frame.withColumn("t", F.when(F.col("n") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="broken"):
        broken.repartition(2).write.format("workbook").mode("overwrite").save(str(one))
    assert one.read_bytes() == before and sorted(p.name for p in tmp_path.iterdir()) == ["one.xlsx", "out"]
    with pytest.raises(Exception, match="FileExists|one.xlsx"):
        frame.write.format("workbook").mode("append").save(str(one))
    made = io.BytesIO()
    assert workbook_target.write_file(made, ["a"], iter([])) == 0
    with pytest.raises(workbook_target.TooManyRows):
        workbook_target.write_file(made, ["a"], ((None, (1,)) for _ in range(workbook_target.SHEET_ROWS)))
    assert [workbook_target.letters(n) for n in (1, 26, 27, 702, 703, 16384)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
