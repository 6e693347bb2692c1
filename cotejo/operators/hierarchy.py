"""Order and checks of trees of boxes, and geometry joins of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo import config
from cotejo.operators import grid
from cotejo.plans.graphs import orders
from cotejo.plans.joins import dealt
from cotejo.plans.saved import saved

def preorder(edges: DataFrame) -> DataFrame:
    """(tree, node, depth, position, boss) of trees given as (tree, node, parent, rank); a root has a null parent.

    Nodes that no root reaches (a cycle, a lost parent) have a null depth and position.  A node that is given several times has the
    place that its least parent (a root's before others) and rank give it.
    """
    first = edges.groupBy("tree", "node").agg(F.min(F.struct("parent", "rank")).alias("first"))
    walked = orders(first.select("tree", "node", "first.parent", "first.rank"))
    return edges.select("tree", "node", F.col("parent").alias("boss")).join(dealt(walked), ["tree", "node"], "left").select("tree", "node", "depth", "position", "boss")


def tree_problems(edges: DataFrame) -> DataFrame:
    """(tree, n_nodes, n_roots, n_repeated, n_lost, sound): one root, one parent for each node, every parent there."""
    nodes = edges.groupBy("tree", "node").agg(F.count("*").alias("n"))
    lost = edges.where("parent IS NOT NULL").join(nodes.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_anti").groupBy("tree").agg(F.count("*").alias("n_lost"))
    out = edges.groupBy("tree").agg(F.countDistinct("node").alias("n_nodes"), F.count_if(F.col("parent").isNull()).alias("n_roots"))
    out = out.join(nodes.where("n > 1").groupBy("tree").agg(F.count("*").alias("n_repeated")), "tree", "left").join(lost, "tree", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_repeated", "n_lost")})
    return out.withColumn("sound", (F.col("n_roots") == 1) & (F.col("n_repeated") == 0) & (F.col("n_lost") == 0))


def box_candidates(boxes: DataFrame) -> DataFrame:
    """Boxes (page, box, x0, y0, x1, y1) over 5 points wide and high whose area is within the band around the page's median."""
    sized = boxes.where("x1 - x0 > 5 AND y1 - y0 > 5").withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    median = sized.groupBy("page").agg(F.percentile("area", 0.5).alias("median"))
    return sized.join(dealt(median), "page").where((F.col("area") >= config.AREA_LOW * F.col("median")) & (F.col("area") <= config.AREA_HIGH * F.col("median"))).drop("median")


def innermost(boxes: DataFrame) -> DataFrame:
    """Boxes that contain no other box of their page, within the slack; equal boxes don't contain each other.  Boxes meet in the cells of a grid."""
    s = config.BOX_SLACK
    sizes = saved(grid.cell_sizes(boxes))
    # the middle of a box that another holds is in a cell which that one touches
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    inner = grid.points_in_cells(boxes, sizes, "box", middle("x0", "x1"), middle("y0", "y1")).select(*grid.CELL, *[F.col(c).alias(f"i_{c}") for c in ("box", "x0", "y0", "x1", "y1")])
    inside = (F.col("i_x0") >= F.col("x0") - s) & (F.col("i_y0") >= F.col("y0") - s) & (F.col("i_x1") <= F.col("x1") + s) & (F.col("i_y1") <= F.col("y1") + s)
    other = (F.col("i_x0") != F.col("x0")) | (F.col("i_y0") != F.col("y0")) | (F.col("i_x1") != F.col("x1")) | (F.col("i_y1") != F.col("y1"))
    holders = grid.boxes_in_cells(boxes, sizes, "box", s).join(inner, grid.CELL).where(inside & other & (F.col("i_box") != F.col("box"))).select("page", "box").distinct()
    return boxes.join(dealt(holders), ["page", "box"], "left_anti")


def box_texts(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, box, text): lines (page, line, text, x0, y0, x1, y1) whose centre a box holds, with a margin, joined in their order."""
    m = config.BOX_MARGIN
    centred = lines.select("page", "line", "text", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    sizes = saved(grid.cell_sizes(boxes))
    points = grid.points_in_cells(centred, sizes, "line", F.col("cx"), F.col("cy"))
    held = grid.boxes_in_cells(boxes, sizes, "box", m).join(points, grid.CELL).where((F.col("cx") >= F.col("x0") - m) & (F.col("cx") <= F.col("x1") + m) & (F.col("cy") >= F.col("y0") - m) & (F.col("cy") <= F.col("y1") + m))
    texts = held.groupBy("page", "box").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("parts"))
    return texts.select("page", "box", F.array_join(F.col("parts.text"), " ").alias("text"))


