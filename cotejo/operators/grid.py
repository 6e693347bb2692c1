"""Joins of boxes, points and intervals by the cells of a grid, so that what is far apart never meets.

A box stands in every cell that it touches, a point in one, so a pair meets once and the join is on equal cells.  Cells are as large as
a page's mean box: a box of the mean size touches four at most, and a page's boxes in all a few times their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.plans.joins import SALTS, dealt, salted

#: Rows of a block that intervals are cut into.
BLOCK = 1024
CELL = ["page", "cell_x", "cell_y"]


def cell_sizes(boxes: DataFrame) -> DataFrame:
    """(page, cell_w, cell_h): mean width and height of each page's boxes, 1 at least."""
    mean = lambda a, b: F.greatest(F.lit(1.0), F.avg(F.abs(F.col(b) - F.col(a))))
    return boxes.groupBy("page").agg(mean("x0", "x1").alias("cell_w"), mean("y0", "y1").alias("cell_h"))


def _sized(df: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """df with its page's cell sizes; rows of pages without boxes go.  by: a column that differs in a page's rows."""
    return salted(dealt(df), dealt(sizes), ["page"], by, F.lit(SALTS))


def _cell(at: Column, size: str) -> Column:
    return F.floor(at / F.col(size)).cast("long")


def boxes_in_cells(boxes: DataFrame, sizes: DataFrame, by: str, margin: float) -> DataFrame:
    """boxes with cell_x and cell_y: a row for each cell that one touches, grown by the margin."""
    span = lambda a, b, size: F.explode(F.sequence(_cell(F.col(a) - margin, size), _cell(F.col(b) + margin, size)))
    out = _sized(boxes.where("x0 <= x1 AND y0 <= y1"), sizes, by)
    return out.withColumn("cell_x", span("x0", "x1", "cell_w")).withColumn("cell_y", span("y0", "y1", "cell_h")).drop("cell_w", "cell_h")


def points_in_cells(points: DataFrame, sizes: DataFrame, by: str, x: Column, y: Column) -> DataFrame:
    """points with the cell that (x, y) is in."""
    out = _sized(points.where(x.isNotNull() & y.isNotNull()), sizes, by)
    return out.withColumn("cell_x", _cell(x, "cell_w")).withColumn("cell_y", _cell(y, "cell_h")).drop("cell_w", "cell_h")


def near_pairs(rects: DataFrame, number: str, near: float) -> DataFrame:
    """(page, number, before): each rectangle (page, number, x0, y0, x1, y1) with those of a smaller number whose four edges are all within ``near``.

    Upper left corners that near are in the same cell of that size or in cells beside it.
    """
    edges = ["x0", "y0", "x1", "y1"]
    own = rects.select("page", number, *edges, *[F.floor(F.col(c) / near).cast("long").alias(k) for c, k in (("x0", "cell_x"), ("y0", "cell_y"))])
    beside = lambda k: F.explode(F.array(*[F.col(k) + i for i in (-1, 0, 1)]))
    other = own.select("page", F.col(number).alias("before"), *[F.col(c).alias(f"o{c}") for c in edges], beside("cell_x").alias("cell_x"), "cell_y").withColumn("cell_y", beside("cell_y"))
    pairs = own.join(dealt(other), CELL).where(F.col("before") < F.col(number))
    for c in edges:
        pairs = pairs.where(F.abs(F.col(c) - F.col(f"o{c}")) <= near)
    return pairs.select("page", number, "before")


def in_intervals(rows: DataFrame, intervals: DataFrame, key: list[str], at: str, low: str, high: str) -> DataFrame:
    """rows joined with the intervals of equal key that hold the whole number ``at``; intervals (low to high, ends included) are cut into blocks of BLOCK numbers.

    Columns of the two other than key must differ.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    cut = intervals.where(F.col(low) <= F.col(high)).withColumn("_block", F.explode(F.sequence(block(low), block(high))))
    return rows.withColumn("_block", block(at)).join(cut, [*key, "_block"]).where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_block")
