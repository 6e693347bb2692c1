"""Files through to positions, results and a report.

Spreadsheets and documents are read as they are.  Charts come as tables of their pages (Parquet folders pages, rects,
lines and segments, and words if pages were recognised, in one folder), since PDF files can't be read here.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo import config
from cotejo.functions import text
from cotejo.operators import blocks, by_id, cells, connectors, hierarchy, lines, proximity, reconcile, sequence
from cotejo.plans import report
from cotejo.plans.graphs import global_order
from cotejo.plans.joins import dealt
from cotejo.plans.saved import saved
from cotejo.sources import office

# What records of unreadable files and bad IDs say.
BAD_WORKBOOK, BAD_DOCUMENT = "Archivo Excel no legible o corrupto: ", ".docx no legible o corrupto: "
BAD_ID, REPEATED_ID = "ID de Excel vacío o inválido; se requiere un entero positivo.", "ID de Excel repetido: "
NO_PDF = "PDF no legible: no hay lector de PDF."


def _letters(n: Column) -> Column:
    """A column's letters, up to XFD."""
    letter = lambda below, width: F.char(F.lit(65) + F.floor((n - below) / width) % 26)
    return F.concat(F.when(n > 702, letter(703, 676)).otherwise(""), F.when(n > 26, letter(27, 26)).otherwise(""), letter(1, 1))


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def excel_positions(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Positions of the workbooks below path: seq, puesto_original, nivel_original, id_excel, error_id, jefe_inmediato, has_ids, error, ubicacion.

    Sheets follow in their workbook's order.  A superior that is given by an ID is named by that row's title.  An
    unreadable workbook is one row with its error.
    """
    read = office.read_workbooks(spark, path, sheet)
    good = read.where("kind = 'cell'").select("file", "sheet", "row", "col", "value")
    merged = read.where("kind = 'merged'").select("file", "sheet", F.col("row").alias("min_row"), F.col("last_row").alias("max_row"), F.col("col").alias("min_col"), F.col("last_col").alias("max_col"))
    found = cells.records(good, merged).join(read.where("kind = 'sheet'").select("file", "sheet", "sheet_no"), ["file", "sheet"])
    columns = F.concat_ws("/", _letters(F.col("title_col")), _letters(F.col("level_col")))
    rows = found.select(
        "file", "sheet_no", "row", F.trim("puesto_original").alias("puesto_original"), "nivel_original", "id_text", F.trim("jefe_text").alias("jefe"), "has_ids",
        F.lit(None).cast("string").alias("error"), text.location(_name(F.col("file")), F.col("sheet"), F.col("row"), columns).alias("ubicacion"),
    )
    nothing = F.lit(None).cast("string")
    bad = read.where("error IS NOT NULL").select("file", F.lit(-1).alias("sheet_no"), F.lit(0).alias("row"), F.lit("").alias("puesto_original"), *[nothing.alias(c) for c in ("nivel_original", "id_text", "jefe")], F.lit(False).alias("has_ids"), F.concat(F.lit(BAD_WORKBOOK), "error").alias("error"), _name(F.col("file")).alias("ubicacion"))
    rows = saved(rows.unionByName(bad))  # to be sampled for ranges without being made twice
    rows = global_order(rows, ["file", "sheet_no", "row"], "seq").withColumn("id_excel", F.when(F.col("has_ids"), text.parse_id(F.col("id_text"))))
    rows = saved(rows.withColumn("jefe_id", text.parse_id(F.col("jefe"))))
    same = rows.where("id_excel IS NOT NULL").groupBy("id_excel").agg(F.count("*").alias("n"))
    bosses = sequence.resolve_boss(rows).select("seq", "boss")
    error = F.when(F.col("has_ids") & F.col("id_excel").isNull(), BAD_ID).when(F.col("n") > 1, F.concat(F.lit(REPEATED_ID), F.col("id_excel").cast("string"), F.lit("."))).otherwise("")
    out = rows.join(same, "id_excel", "left").join(bosses, "seq")
    return out.select("seq", "puesto_original", "nivel_original", "id_excel", error.alias("error_id"), F.coalesce("boss", "jefe").alias("jefe_inmediato"), "has_ids", "error", "ubicacion")


def word_positions(spark: SparkSession, path: str) -> DataFrame:
    """Positions of the document (or of a folder's documents): seq, puesto_original, nivel_original, cantidad, error, ubicacion.

    A folder with Parquet folders texts and tables holds the pages of converted documents (page_positions).  A PDF file is one row with an error; other kinds raise ValueError.
    """
    kind = os.path.splitext(path)[1].lower()
    if kind == ".pdf":
        return spark.sql("SELECT 0L AS seq, '' AS puesto_original, CAST(NULL AS STRING) AS nivel_original, CAST(NULL AS STRING) AS cantidad, :error AS error, :file AS ubicacion", args={"error": NO_PDF, "file": os.path.basename(path)})
    if _there(spark, f"{path.rstrip('/')}/texts"):
        return page_positions(*(spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("texts", "tables")))
    if kind not in ("", ".docx"):
        raise ValueError(f"Extensión no soportada para el extractor de Word: {kind}")
    read = office.read_doc_rows(spark, path)
    place = text.location(_name(F.col("file")), table=F.col("table_idx") + 1, table_row=F.col("row_idx"))
    good = cells.table_records(read.where("error IS NULL").drop("error")).withColumns({"error": F.lit(None).cast("string"), "ubicacion": place})
    nothing = F.lit(None).cast("string")
    bad = read.where("error IS NOT NULL").select("file", F.lit(-1).alias("table_idx"), F.lit(0).alias("row_idx"), F.lit("").alias("puesto_original"), nothing.alias("nivel_original"), nothing.alias("cantidad"), F.concat(F.lit(BAD_DOCUMENT), "error").alias("error"), _name(F.col("file")).alias("ubicacion"))
    rows = global_order(good.unionByName(bad), ["file", "table_idx", "row_idx"], "seq")
    return rows.select("seq", "puesto_original", "nivel_original", "cantidad", "error", "ubicacion")


#: Characters below which a converted page counts as an image, and how far its methods are relied on.
PAGE_TEXT, OF_TABLES, OF_LINES = 5, 1.0, 0.9
_ENDS = r"^\s+|\s+$"
_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def page_records(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """Positions of documents that were converted to pages: file, page, table_idx, row, puesto_original, nivel_original, cantidad, confidence.

    texts has file, page and text; tables file, page, table_idx, row_idx (from 1) and cells.  Pages of under PAGE_TEXT characters are passed
    over, with their tables.  A page's tables give its positions; tables count through a file's pages.  Of a page whose tables
    give none the lines that fit a pattern are taken: table_idx is null and row their line's number.
    """
    told = texts.where(F.length(F.regexp_replace("text", _ENDS, "")) >= PAGE_TEXT).select("file", F.col("page").cast("int").alias("page"), "text")
    told = saved(told)
    own = tables.withColumn("page", F.col("page").cast("int")).join(told.select("file", "page").distinct(), ["file", "page"], "left_semi")
    order = global_order(own.select("file", "page", "table_idx").distinct(), ["file", "page", "table_idx"], "place")
    first = order.groupBy("file").agg(F.min("place").alias("first"))
    order = order.join(first, "file").select("file", "page", "table_idx", (F.col("place") - F.col("first") + 1).cast("int").alias("number"))
    trimmed = F.transform("cells", lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), _ENDS, ""))
    rows = own.join(order, ["file", "page", "table_idx"]).select("file", F.col("number").alias("table_idx"), "row_idx", trimmed.alias("cells"))
    found = cells.table_records(rows).join(order.select("file", "page", F.col("number").alias("table_idx")), ["file", "table_idx"])
    found = saved(found.select("file", "page", "table_idx", F.col("row_idx").alias("row"), "puesto_original", F.nullif("nivel_original", F.lit("")).alias("nivel_original"), F.nullif("cantidad", F.lit("")).alias("cantidad"), F.lit(OF_TABLES).alias("confidence")))
    bare = told.join(found.select("file", "page").distinct(), ["file", "page"], "left_anti")
    split = bare.select("file", "page", F.posexplode(F.split("text", _BREAKS)).alias("at", "text")).select("file", "page", (F.col("at") + 1).alias("line_no"), "text")
    read = lines.pattern_records(split).select("file", "page", F.lit(None).cast("int").alias("table_idx"), F.col("line_no").alias("row"), "puesto_original", "nivel_original", "cantidad", F.lit(OF_LINES).alias("confidence"))
    return found.unionByName(read)


def page_positions(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """page_records as a source: seq, puesto_original, nivel_original, cantidad, error, ubicacion."""
    place = text.location(_name(F.col("file")), page=F.col("page"), table=F.col("table_idx"), table_row=F.col("row"))
    rows = global_order(page_records(texts, tables), ["file", "page", "table_idx", "row"], "seq")
    return rows.select("seq", "puesto_original", "nivel_original", "cantidad", F.lit(None).cast("string").alias("error"), place.alias("ubicacion"))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def chart_positions(pages: DataFrame, rects: DataFrame, page_lines: DataFrame, segments: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Positions of charts: file, page, seq, puesto_original, nivel_original, jefe_inmediato, jerarquia_verificada, error_orden, posicion_lectura, ubicacion.

    All have file and page; pages height, rects rect_no and x0 to y1, page_lines line, text and x0 to y1, segments seg, kind and x0
    to y1.  A page's boxes give its positions, ordered by their connectors; pages without boxes are read by nearness.  words (see
    blocks.word_lines) are what was recognised in the images of pages; they count where a page has next to no text of its own.
    """
    if words is not None:
        read_alone = blocks.word_lines(words).join(dealt(blocks.own_text(page_lines)), ["file", "page"], "left_anti")
        page_lines = page_lines.join(dealt(blocks.own_text(page_lines)), ["file", "page"], "left_semi").select("file", "page", "line", "text", "x0", "y0", "x1", "y1").unionByName(read_alone.select("file", F.col("page"), "line", "text", "x0", "y0", "x1", "y1"))
    rects, page_lines, segments = (df.withColumn("page", F.struct("file", F.col("page").cast("int").alias("page"))).drop("file") for df in (rects, page_lines, segments))
    sized = rects.where("x1 - x0 > 5 AND y1 - y0 > 5")
    boxes = saved(hierarchy.innermost(hierarchy.box_candidates(connectors.unique_boxes(sized).withColumnRenamed("rect_no", "box"))).select("page", "box", "x0", "y0", "x1", "y1"))
    cleaned = hierarchy.box_texts(boxes, page_lines).select("page", "box", lines.clean_box(F.col("text")).alias("c")).select("page", "box", "c.title", F.col("c.level").alias("level"))
    told = saved(connectors.positions(boxes.join(dealt(cleaned), ["page", "box"])))
    ordered = connectors.order_by_connectors(told, segments)
    read = told.join(dealt(ordered), ["page", "box"]).select("page.file", "page.page", "x0", "y0", "title", "level", "boss", "verified", "error", "position", (F.coalesce("position", "reading_order")).alias("_place"))
    bare = page_lines.join(dealt(boxes.select("page").distinct()), "page", "left_anti").select("page.file", F.col("page.page").alias("page"), "line", "text", "x0", "y0", "x1", "y1")
    near = proximity.proximity_records(bare, pages).select("file", "page", "x0", "y0", "title", "level", F.lit(None).cast("string").alias("boss"), F.lit(False).alias("verified"), "error", F.lit(None).cast("long").alias("position"), F.col("box").alias("_place"))
    rows = connectors.over_pages(saved(read.unionByName(near)))
    place = text.location(_name(F.col("file")), page=F.col("page"), about=F.format_string("x=%.0f,y=%.0f", "x0", "y0"))
    return global_order(rows, ["file", "page", "_place"], "seq").select(
        "file", "page", "seq", F.col("title").alias("puesto_original"), F.col("level").alias("nivel_original"), F.col("boss").alias("jefe_inmediato"), F.col("verified").alias("jerarquia_verificada"), F.col("error").alias("error_orden"),
        F.col("position").cast("long").alias("posicion_lectura"), place.alias("ubicacion"),
    )


def read_chart(spark: SparkSession, folder: str) -> DataFrame:
    """chart_positions of the tables in the folder; a PDF file is one row with an error."""
    if folder.lower().endswith(".pdf"):
        return spark.sql("SELECT 0L AS seq, '' AS puesto_original, CAST(NULL AS STRING) AS nivel_original, :error AS error, :file AS ubicacion", args={"error": NO_PDF, "file": os.path.basename(folder)})
    folder = folder.rstrip("/")
    words = spark.read.parquet(f"{folder}/words") if _there(spark, f"{folder}/words") else None
    return chart_positions(*(spark.read.parquet(f"{folder}/{name}") for name in ("pages", "rects", "lines", "segments")), words)


def compare(excel: DataFrame, word: DataFrame | None, chart: DataFrame) -> DataFrame:
    """Results with homologation: by ID where the reference has a column of IDs, else by name; without documents (None) they take no part."""
    excel, chart = saved(excel), saved(chart)
    word = saved(word) if word is not None else None
    with_word = word is not None
    if not excel.where(F.col("has_ids") | F.col("id_excel").isNotNull()).isEmpty():
        return report.homologation(by_id.compare_by_id(excel, word, chart).drop("homologation", "similarity"), None, with_word)
    sources = {"excel": excel, "organigrama": chart} | ({"word": word} if with_word else {})
    return report.homologation(saved(reconcile.report_sections(sources)), sources, with_word)
