"""Joins by cells against all pairs and at sizes where all pairs would be too many; blocks of words and pages of documents."""

import random

from pyspark.sql import functions as F

from cotejo.operators import blocks, cells, connectors, grid, hierarchy
from cotejo.plans import files

BOX = "x0 double, y0 double, x1 double, y1 double"


def boxes(rng, n, far):
    out = []
    for i in range(n):
        x, y = rng.uniform(-far, far), rng.uniform(-far, far)
        out.append((i, x, y, x + rng.choice([1.0, 8.0, 30.0, far / 2]), y + rng.uniform(0, 25)))
    return out


def test_cells_leave_nothing_out(spark):
    rng = random.Random(4)
    rows = [(p, *b) for p in (1, 2, 3) for b in boxes(rng, 60, 90)] + [(4, 0, 1.0, 1.0, 1.0, 1.0), (5, 0, None, 1.0, 2.0, 3.0)]
    frame = spark.createDataFrame(rows, f"page int, box int, {BOX}")
    lines = [(p, i, f"t{i}", x, y, x + 3, y + 2) for p in (1, 2, 3, 9) for i, x, y, _, _ in boxes(rng, 80, 90)] + [(1, 99, "no place", None, 1.0, 2.0, 3.0)]
    texts = spark.createDataFrame(lines, f"page int, line int, text string, {BOX}")
    inside = lambda b, i: i[2] >= b[2] - 1 and i[3] >= b[3] - 1 and i[4] <= b[4] + 1 and i[5] <= b[5] + 1
    whole = [r for r in rows if None not in r]
    holders = {b[:2] for b in whole for i in whole if b[0] == i[0] and b[1] != i[1] and b[2:] != i[2:] and inside(b, i)}
    got = {(r.page, r.box) for r in hierarchy.innermost(frame.where("x0 IS NOT NULL")).collect()}
    assert got == {r[:2] for r in whole} - holders and len(holders) > 10
    want = {}
    for b in whole:
        own = [ln[2] for ln in sorted(lines, key=lambda x: x[1]) if ln[0] == b[0] and ln[3] is not None and b[2] - 2 <= (ln[3] + ln[5]) / 2 <= b[4] + 2 and b[3] - 2 <= (ln[4] + ln[6]) / 2 <= b[5] + 2]
        if own:
            want[b[:2]] = " ".join(own)
    assert {(r.page, r.box): r.text for r in hierarchy.box_texts(frame, texts).collect()} == want and len(want) > 20
    near = {(b[0], b[1], a[1]) for a in whole for b in whole if a[0] == b[0] and a[1] < b[1] and all(abs(x - y) <= 3 for x, y in zip(a[2:], b[2:], strict=True))}
    crowd = [(7, i, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(20, 24), rng.uniform(20, 24)) for i in range(60)]
    near |= {(7, b[1], a[1]) for a in crowd for b in crowd if a[1] < b[1] and all(abs(x - y) <= 3 for x, y in zip(a[2:], b[2:], strict=True))}
    found = grid.near_pairs(spark.createDataFrame(whole + crowd, f"page int, box int, {BOX}"), "box", 3.0).collect()
    assert len(found) == len(near) and {tuple(r) for r in found} == near


def test_a_page_of_many_boxes(spark):
    """100,000 boxes on one page, each with a line and every tenth with a box inside."""
    i = F.col("id")
    x, y = (i % 400 * 30).cast("double"), (F.floor(i / 400) * 30).cast("double")
    big = spark.range(100_000).select(F.lit(1).alias("page"), i.alias("box"), x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 20).alias("y1"))
    small = big.where("box % 10 = 0").select("page", (F.col("box") + 1_000_000).alias("box"), *[(F.col(c) + d).alias(c) for c, d in (("x0", 5), ("y0", 5), ("x1", -5), ("y1", -5))])
    assert hierarchy.innermost(big.unionByName(small)).count() == 100_000
    lines = big.select("page", F.col("box").alias("line"), F.col("box").cast("string").alias("text"), "x0", "y0", "x1", "y1")
    texts = hierarchy.box_texts(big, lines)
    assert texts.where(F.col("text") == F.col("box").cast("string")).count() == 100_000
    assert connectors.unique_boxes(big.withColumnRenamed("box", "rect_no").unionByName(big.select("page", (F.col("box") + 200_000).alias("rect_no"), *[(F.col(c) + 1).alias(c) for c in ("x0", "y0", "x1", "y1")]))).count() == 100_000


def test_a_merged_range_over_a_sheet(spark):
    rows = [("f", "s", r, 12, "boss" if r == 2 else None) for r in (2, 3, 500_000, 1_048_576)] + [("f", "s", 7, 10, "title"), ("f", "other", 7, 10, "title")]
    frame = spark.createDataFrame(rows, "file string, sheet string, row int, col int, value string")
    merged = spark.createDataFrame([("f", "s", 2, 1_048_576, 12, 13), ("f", "none", 1, 5, 1, 1)], "file string, sheet string, min_row int, max_row int, min_col int, max_col int")
    got = {(r.sheet, r.row, r.col): r.value for r in cells.fill_merged(frame, merged).collect()}
    assert got == {("s", r, 12): "boss" for r in (2, 3, 7, 500_000, 1_048_576)} | {("s", 7, 10): "title", ("other", 7, 10): "title"}


def test_words_and_spans(spark):
    words = [("f", 1, i, b, p, n, t, left, 300, 100, 50) for i, (b, p, n, t, left) in enumerate([(1, 1, 1, " Enlace ", 300), (1, 1, 2, "Nivel", 300), (1, 1, 1, "de", 450), (1, 1, 2, "21", 600), (1, 1, 3, " ", 0), (1, 2, 1, None, 0)])]
    frame = spark.createDataFrame(words, "file string, page int, word int, block int, par int, line_no int, text string, left int, top int, width int, height int")
    got = [(r.line, r.text, r.x0, r.y0, r.x1, r.y1) for r in blocks.word_lines(frame).orderBy("line").collect()]
    assert got == [(0, "Enlace de", 72.0, 72.0, 132.0, 84.0), (1, "Nivel 21", 72.0, 72.0, 168.0, 84.0)]
    spans = [("f", 1, b, k, n, s, t, 1.0, 2.0, 3.0, 4.0) for b, k, n, s, t in [(0, 0, 0, 0, " a"), (0, 0, 0, 1, "b "), (0, 0, 1, 0, "\t "), (0, 0, 2, 0, "c"), (1, 1, 0, 0, "image"), (2, 0, 0, 0, " ")]]
    told = blocks.text_blocks(spark.createDataFrame(spans, f"file string, page int, block int, kind int, line_no int, span int, text string, {BOX}")).collect()
    assert [(r.line, r.text) for r in told] == [(0, "ab\nc")]


def test_recognised_pages_of_a_chart(spark):
    """A page with next to no text of its own is read from what was recognised, another isn't."""
    lines = spark.createDataFrame([("o", 1, 0, "x", 0.0, 0.0, 9.0, 9.0), ("o2", 1, 0, "Dirección General 45", 0.0, 0.0, 90.0, 9.0)], f"file string, page int, line int, text string, {BOX}")
    words = [(f, 1, i, 1, 1, 1, t, 300 + 100 * i, 300, 90, 40) for f in ("o", "o2") for i, t in enumerate(["Enlace", "de", "Compras", "21"])]
    words = spark.createDataFrame(words, "file string, page int, word int, block int, par int, line_no int, text string, left int, top int, width int, height int")
    pages = spark.createDataFrame([("o", 1, 400.0), ("o2", 1, 400.0)], "file string, page int, height double")
    none = spark.createDataFrame([], f"file string, page int, rect_no int, {BOX}")
    drawn = spark.createDataFrame([], f"file string, page int, seg int, kind string, {BOX}")
    got = {r.file: (r.puesto_original, r.nivel_original) for r in files.chart_positions(pages, none, lines, drawn, words).collect()}
    assert got == {"o": ("Enlace de Compras", "21"), "o2": ("Dirección General", "45")}


def test_pages_of_a_document(spark, tmp_path):
    texts = [("d.pdf", 1, "Puesto y nivel"), ("d.pdf", 2, " \n abc"), ("d.pdf", 3, "1 Enlace de Apoyo 21\r\nTotal 5\n2 Jefatura de\x0bUnidad 25"), ("d.pdf", 4, None)]
    rows = [("d.pdf", 1, 0, 1, ["Puesto", "Nivel"]), ("d.pdf", 1, 0, 2, [" Asesor ", None]), ("d.pdf", 2, 0, 1, ["Puesto", "Nivel"]), ("d.pdf", 2, 0, 2, ["Nadie", "1"]), ("d.pdf", 3, 0, 1, ["Área", "Nivel"]), ("d.pdf", 3, 0, 2, ["x", "1"])]
    spark.createDataFrame(texts, "file string, page int, text string").write.parquet(f"{tmp_path}/texts")
    spark.createDataFrame(rows, "file string, page int, table_idx int, row_idx int, cells array<string>").write.parquet(f"{tmp_path}/tables")
    got = [(r.puesto_original, r.nivel_original, r.cantidad, r.ubicacion) for r in files.word_positions(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [("Asesor", None, None, "d.pdf | pág=1 | tabla=1 | fila_tabla=2"), ("Enlace de Apoyo", "21", "1", "d.pdf | pág=3 | fila_tabla=1"), ("Jefatura de Unidad", "25", "2", "d.pdf | pág=3 | fila_tabla=3")]
