"""Positions of chart pages that have no boxes: text blocks near to each other are one position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo import config
from cotejo.functions import text
from cotejo.plans.joins import dealt

# The distance of blocks as a share of the page's height, how far blocks may overlap or stand aside in such distances.
SHARE, OVERLAP, ASIDE = 0.03, 3, 4
# Patterns of a level, the first that occurs holds; what such records say of their order.
LEVELS = [r"(?i)nivel\s*[:\-]?\s*\d{1,3}", r"(?i)\bn[ivl]*[.\-]?\s*\d{1,3}\b", r"\b\d{1,3}\b"]
UNORDERED = "Orden no verificable: lectura por OCR/cercanía, sin conectores verificables."
PAGE_NUMBER = [r"^p[aá]gina\s*\d+"]
EDGES = ["x0", "y0", "x1", "y1"]


def clusters(boxes: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of the boxes (x0, y0, x1, y1), which are in reading order, the place of its cluster's first one, and when it joined.

    The first free box begins a cluster.  The next free box near to the cluster's outline joins it, and the search goes on
    behind that box, from the start again at the end, until no free box is near.
    """
    label, joined = np.full(len(boxes), -1), np.zeros(len(boxes), "int64")
    for first in range(len(boxes)):
        if label[first] >= 0:
            continue
        label[first], at, outline = first, -1, boxes[first].copy()
        while True:
            gap = boxes[:, 1] - outline[3]
            near = (gap <= margin) & (gap >= -OVERLAP * margin) & (boxes[:, 2] >= outline[0] - ASIDE * margin) & (boxes[:, 0] <= outline[2] + ASIDE * margin)
            hits = np.flatnonzero(near & (label < 0))
            if not hits.size:
                break
            behind = hits[hits > at]
            at = behind[0] if behind.size else hits[0]
            label[at], joined[at] = first, joined.max() + 1
            outline[:2] = np.minimum(outline[:2], boxes[at, :2])
            outline[2:] = np.maximum(outline[2:], boxes[at, 2:])
    return label, joined


def proximity_clusters(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, page, box, text, x0, y0, x1, y1): the clusters of each page's text blocks; a page is one group.

    blocks has file, page, line, text and x0 to y1; pages has file, page and height.  box is the cluster's first block
    in the order from top to bottom, from left to right; texts are joined as they joined.  Blocks of no text or without a place are left out.
    """

    def page(own: pa.Table) -> pa.Table:
        at = np.lexsort([own.column(c).to_numpy() for c in ("line", "x0", "y0")])
        corners = np.column_stack([own.column(c).to_numpy() for c in EDGES])[at]
        label, joined = clusters(corners, own.column("height")[0].as_py() * SHARE)
        order = np.lexsort((joined, label))
        box, begins = np.unique(label[order], return_index=True)
        said = np.array(own.column("text").to_pylist(), dtype=object)[at][order]
        texts = [" ".join(part) for part in np.split(said, begins[1:])]
        outline = [pa.array(c, from_pandas=True) for c in (*np.fmin.reduceat(corners[order, :2], begins).T, *np.fmax.reduceat(corners[order, 2:], begins).T)]
        names = [own.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(box), "int64"))) for c in ("file", "page")]
        return pa.table([*names, box, texts, *outline], names=["file", "page", "box", "text", *EDGES])

    placed = blocks.where("text IS NOT NULL AND trim(text) <> '' AND x0 + y0 + x1 + y1 IS NOT NULL").join(dealt(pages.where("height IS NOT NULL").dropDuplicates(["file", "page"])), ["file", "page"])
    rows = placed.select("file", F.col("page").cast("int").alias("page"), F.col("line").cast("long").alias("line"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), *[F.col(c).cast("double").alias(c) for c in (*EDGES, "height")])
    return rows.groupBy("file", "page").applyInArrow(page, "file string, page int, box long, text string, x0 double, y0 double, x1 double, y1 double")


def proximity_records(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Clusters that are positions: file, page, box, x0 to y1, title, level and error; captions, page numbers and titles of under two characters are none."""
    found = proximity_clusters(blocks, pages).withColumn("text", F.trim("text"))
    told = found.where((F.length("text") >= 2) & ~text.is_noise(text.normalise_title(F.col("text")), PAGE_NUMBER + config.CHART_NOISE))
    levels = [F.nullif(F.regexp_extract("text", p, 0), F.lit("")) for p in LEVELS]
    rest = [F.when(level.isNotNull(), F.regexp_replace("text", rf"^([\s\S]*?)(?:{p})([\s\S]*)$", "$1$2")) for level, p in zip(levels, LEVELS, strict=True)]
    titled = told.withColumns({"title": F.trim(F.coalesce(*rest, "text")), "level": F.coalesce(*levels)}).where(F.length("title") >= 2)
    return titled.select("file", "page", "box", "x0", "y0", "x1", "y1", "title", "level", F.lit(UNORDERED).alias("error"))
