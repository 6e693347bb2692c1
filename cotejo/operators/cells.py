"""Spreadsheet cells and document rows as relations: headers, columns, merged cells and records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo import config
from cotejo.functions import text
from cotejo.operators.grid import in_intervals
from cotejo.plans.saved import saved


def _has(value: Column, headers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(value, F.lit(h)) for h in headers])


def _boss(value: Column) -> Column:
    return reduce(lambda a, b: a | b, [(value == h) | value.startswith(f"{h} ") for h in config.BOSS_HEADERS])


def header_rows(cells: DataFrame) -> DataFrame:
    """(file, sheet, row, level_col, title_col) of each sheet's first row, up to HEADER_ROWS, with both headers.

    cells has file, sheet, row, col and value.  Level headers are tested before title headers, boss
    headers count as neither, and of several cells the last one holds.
    """
    value = text.normalise_title(F.col("value"))
    role = F.when(_boss(value), None).when(_has(value, config.LEVEL_HEADERS), "level").when(_has(value, config.TITLE_HEADERS), "title")
    rows = cells.where(F.col("row") <= config.HEADER_ROWS).withColumn("role", role).groupBy("file", "sheet", "row")
    both = rows.agg(F.max(F.when(F.col("role") == "level", F.col("col"))).alias("level_col"), F.max(F.when(F.col("role") == "title", F.col("col"))).alias("title_col"))
    both = both.where("level_col IS NOT NULL AND title_col IS NOT NULL")
    first = both.groupBy("file", "sheet").agg(F.min(F.struct("row", "level_col", "title_col")).alias("h"))
    return first.select("file", "sheet", "h.row", "h.level_col", "h.title_col")


def columns(cells: DataFrame) -> DataFrame:
    """(file, sheet, header_row, title_col, level_col, id_col, boss_col) of each sheet, with the fixed places where there is no header."""
    sheets = cells.groupBy("file", "sheet").agg(F.max("col").alias("last"))
    found = sheets.join(header_rows(cells).withColumnRenamed("row", "header_row"), ["file", "sheet"], "left")
    found = found.select(
        "file", "sheet", "last", F.coalesce("header_row", F.lit(1)).alias("header_row"), F.coalesce("title_col", F.lit(config.FALLBACK_TITLE)).alias("title_col"), F.coalesce("level_col", F.lit(config.FALLBACK_LEVEL)).alias("level_col")
    )
    joined = cells.join(found, ["file", "sheet"])
    heading = joined.where(F.col("row") == F.col("header_row")).withColumn("name", text.normalise_title(F.col("value")))
    free = ~F.col("col").isin(F.col("title_col"), F.col("level_col"))
    boss = heading.where(free & (F.col("col") != config.FALLBACK_ID) & _boss(F.col("name"))).groupBy("file", "sheet").agg(F.min("col").alias("boss"))
    ids = joined.where((F.col("col") == config.FALLBACK_ID) & free & (F.col("row") >= F.col("header_row")) & F.col("value").isNotNull())
    named = (F.col("row") == F.col("header_row")) & text.normalise_title(F.col("value")).isin(*config.ID_HEADERS)
    ids = ids.groupBy("file", "sheet").agg(F.bool_or(named | (F.col("row") > F.col("header_row"))).alias("has_id"))
    out = found.join(boss, ["file", "sheet"], "left").join(ids, ["file", "sheet"], "left")
    id_col = F.when(F.col("has_id"), F.lit(config.FALLBACK_ID))
    spare = (F.col("last") >= config.FALLBACK_BOSS) & ~F.lit(config.FALLBACK_BOSS).isin(F.col("title_col"), F.col("level_col"))
    return out.select("file", "sheet", "header_row", "title_col", "level_col", id_col.alias("id_col"), F.coalesce("boss", F.when(spare, F.lit(config.FALLBACK_BOSS))).alias("boss_col"))


def fill_merged(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """cells with the value of the upper left cell of the merged range that covers them, where they are empty; blanks elsewhere stay.

    merged has file, sheet, min_row, max_row, min_col and max_col.  A range's first column holds for the rows of its sheet that have a
    cell at all, which get one there; rows and ranges are joined by blocks of rows, so a range over a whole sheet costs a row for each block.
    """
    tops = cells.select("file", "sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.col("value").alias("top_value"))
    valued = merged.select("file", "sheet", "min_row", "max_row", "min_col").join(tops, ["file", "sheet", "min_row", "min_col"])
    rows = cells.select("file", "sheet", "row").distinct()
    filled = in_intervals(rows, valued, ["file", "sheet"], "row", "min_row", "max_row").select("file", "sheet", "row", F.col("min_col").alias("col"), "top_value")
    return cells.join(filled, ["file", "sheet", "row", "col"], "full").select("file", "sheet", "row", "col", F.coalesce(F.when(F.trim("value") != "", F.col("value")), F.col("top_value")).alias("value"))


def records(cells: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Positions of spreadsheets: file, sheet, row, puesto_original, nivel_original, id_text, jefe_text, has_ids, title_col, level_col.

    Rows without a title, repeated headers and summary rows go.  Of merged ranges those that begin in the
    column of the superior hold for all their rows; other columns are read as they are.
    """
    places = columns(cells)
    if merged is not None:
        places = saved(places)
        bosses = places.select("file", "sheet", F.col("boss_col").alias("min_col"))
        cells = fill_merged(cells.select("file", "sheet", "row", "col", "value"), merged.join(bosses, ["file", "sheet", "min_col"], "left_semi"))
    placed = cells.join(places, ["file", "sheet"]).where(F.col("row") > F.col("header_row"))
    pick = lambda c: F.max(F.when(F.col("col") == F.col(c), F.col("value")))
    rows = placed.groupBy("file", "sheet", "row").agg(pick("title_col").alias("puesto_original"), pick("level_col").alias("nivel_original"), pick("id_col").alias("id_text"), pick("boss_col").alias("jefe_text"), F.bool_or(F.col("id_col").isNotNull()).alias("has_ids"), F.max("title_col").alias("title_col"), F.max("level_col").alias("level_col"))
    level = text.normalise_title(F.col("nivel_original"))

    def kept(title: Column) -> Column:
        repeated = title.isin(*config.TITLE_HEADERS, "nombre del puesto", "denominacion del puesto") & ((level == "") | _has(level, config.LEVEL_HEADERS))
        summed = reduce(lambda a, b: a | b, [title.startswith(p) for p in config.SUMMARY_PREFIXES])
        return (title != "") & ~repeated & ~summed

    return rows.where(text.once(text.normalise_title(F.col("puesto_original")), kept))


def table_records(rows: DataFrame) -> DataFrame:
    """Positions of document tables: file, table_idx, row_idx, puesto_original, nivel_original, cantidad.

    rows has file, table_idx, row_idx (from 1) and cells (array).  The first row is the header: of each
    role, level before quantity before title, the first cell that fits holds; a second level header
    falls through to title.  Tables without a title column and noise rows give nothing.
    """
    names = F.transform("cells", lambda c: text.normalise_title(c))

    def fold(acc: Column, cell: Column) -> Column:
        i, level, quantity, title = acc["i"], acc["level"], acc["quantity"], acc["title"]
        is_level = _has(cell, config.LEVEL_HEADERS)
        is_quantity = reduce(lambda a, b: a | b, [(cell == h) | cell.startswith(f"{h} ") for h in config.QUANTITY_HEADERS])
        is_title = _has(cell, config.DOC_TITLE_HEADERS)
        to_level = is_level & level.isNull()
        to_quantity = ~to_level & is_quantity & quantity.isNull()
        to_title = ~to_level & ~to_quantity & is_title & title.isNull()
        return F.struct((i + 1).alias("i"), F.when(to_level, i).otherwise(level).alias("level"), F.when(to_quantity, i).otherwise(quantity).alias("quantity"), F.when(to_title, i).otherwise(title).alias("title"))

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), none.alias("level"), none.alias("quantity"), none.alias("title"))
    heads = rows.where("row_idx = 1").select("file", "table_idx", F.aggregate(names, start, fold).alias("h"))
    body = rows.where("row_idx > 1").join(heads.where("h.title IS NOT NULL"), ["file", "table_idx"])
    pick = lambda role: F.trim(F.get("cells", F.col(f"h.{role}")))
    found = body.select("file", "table_idx", "row_idx", pick("title").alias("puesto_original"), pick("level").alias("nivel_original"), pick("quantity").alias("cantidad"))
    return found.where(~text.is_noise(text.normalise_title(F.col("puesto_original")), config.DOC_NOISE))
