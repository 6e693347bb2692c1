"""Text blocks of pages from the words that were recognised in an image, and from the spans that a page's text is made of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dots per inch of a page's image, points per inch, and the characters from which on a page has text of its own.
DPI, POINTS, OWN_TEXT = 300, 72, 15


_ENDS = " \t\n\x0b\f\r"


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_ENDS))


def _joined(parts: str, order: str, separator: str) -> Column:
    """The texts of collected (order, text) structs, in that order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, parts))), lambda p: p[parts]), separator)


OUTLINE = ["x0", "y0", "x1", "y1"]


def _runs(parts: DataFrame, key: list[str], number: str, separator: str, outer: bool) -> DataFrame:
    """parts (key, number, text, x0 to y1) with those joined that follow one another in a batch, have one key and follow one another in number too.

    No other part's number lies between them, so they are one part of the first one's number, with their outline (outer) or the
    first one's.  A page's words come in their order mostly, so about a row for each line is left to be shuffled and sorted.  Rows are dealt
    by page, so whoever groups by the key shuffles them no more.
    """
    parts = parts.select(*key, number, "text", *[F.col(c).cast("double").alias(c) for c in OUTLINE])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            new = np.ones(len(batch), bool)
            at = batch.column(number)
            follows = pc.fill_null(pc.equal(at[1:], pc.add(at[:-1], 1)), False)
            for c in key:
                follows = pc.and_(follows, pc.fill_null(pc.equal(batch.column(c)[1:], batch.column(c)[:-1]), False))
            new[1:] = ~follows.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            texts = pa.ListArray.from_arrays(pa.array(np.append(first, len(batch)), pa.int32()), batch.column("text"))
            made = {"text": pc.binary_join(texts, separator)}
            for c, least in zip(OUTLINE, (np.fmin, np.fmin, np.fmax, np.fmax), strict=True) if outer else ():
                edge = least.reduceat(batch.column(c).to_numpy(zero_copy_only=False), first)
                made[c] = pa.array(edge, mask=np.isnan(edge))
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name).take(pa.array(first)) for f in batch.schema], names=batch.schema.names)

    return parts.mapInArrow(join, parts.schema).repartition("file", "page")


def word_lines(words: DataFrame, dpi: int = DPI) -> DataFrame:
    """(file, page, line, text, x0, y0, x1, y1) of recognised words: one for each line of a paragraph, with the outline of its words in points.

    words has file, page, word (its number on the page), block, par, line_no (which name a line), text, and left, top, width and height in
    the image's dots.  Texts are trimmed, blank and null ones are left out; words are joined by spaces in the order of their numbers,
    and line counts a page's lines by their first words' numbers.
    """
    zoom = dpi / POINTS
    said = words.withColumn("text", _stripped(F.col("text"))).where("text <> ''")
    x0, y0 = F.col("left") / zoom, F.col("top") / zoom
    x1, y1 = (F.col("left") + F.col("width")) / zoom, (F.col("top") + F.col("height")) / zoom
    key = ["file", "page", "block", "par", "line_no"]
    parts = _runs(said.select(*key, "word", "text", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")), key, "word", " ", True)
    grouped = parts.groupBy(*key).agg(
        F.min("word").cast("long").alias("line"), _joined("text", "word", " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    return grouped.select("file", "page", "line", "text", "x0", "y0", "x1", "y1")


def text_blocks(spans: DataFrame) -> DataFrame:
    """(file, page, line, text, x0, y0, x1, y1) of a page's text blocks, a line of text for each of theirs.

    spans has file, page, block, kind (0: text), line_no, span, text and the block's outline x0 to y1.  The spans of a line are joined as they
    are, lines are trimmed, blank ones and blocks without others are left out, and so are images; line is the block's number.
    """
    key = ["file", "page", "block", "line_no"]
    whole = _runs(spans.where("kind = 0 AND text IS NOT NULL"), key, "span", "", False).groupBy(*key)
    lines = whole.agg(_stripped(_joined("text", "span", "")).alias("text"), *[F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")]).where("text <> ''")
    blocks = lines.groupBy("file", "page", "block").agg(_joined("text", "line_no", "\n").alias("text"), *[F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return blocks.select("file", "page", F.col("block").cast("long").alias("line"), "text", "x0", "y0", "x1", "y1")


def own_text(page_lines: DataFrame, least: int = OWN_TEXT) -> DataFrame:
    """(file, page) of the pages that have text of their own: at least so many characters, white space at the ends not counted."""
    told = page_lines.groupBy("file", "page").agg(F.length(_stripped(_joined("text", "line", "\n"))).alias("n"))
    return told.where(F.col("n") >= least).select("file", "page")
