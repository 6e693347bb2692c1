"""Components of graphs and order of trees, in rounds that grow with the logarithm of a chain's length."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.plans.joins import SALTS, salted
from cotejo.plans.saved import saved


def _to_least(links: DataFrame, upwards: bool) -> DataFrame:
    """Links (a, b), a > b: neighbours of a node tied to the least of them and it, the larger neighbours (upwards) or the smaller ones and the node itself."""
    if upwards:  # a node's larger neighbours are the a of its links as b; the least neighbour is the b of its links as a
        least = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        found = salted(links, least.withColumnRenamed("node", "b"), ["b"], "a", F.lit(SALTS), "left").select("a", F.coalesce("least", "b").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("least"))
        tied = salted(links, least, ["a"], "b", F.lit(SALTS)).select(F.col("b").alias("a"), F.col("least").alias("b"))
        found = tied.union(least.select("a", F.col("least").alias("b")))
    return found.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b): the smallest node that links reach, for itself too.

    Links are turned, by turns, to the least neighbour of their smaller end and of their larger one, until each node is tied to its
    component's least; a chain halves in each round.  Each round is saved.
    """
    nodes = saved(links.select(F.col("a").alias("node")).union(links.select("b")).distinct())
    now = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        now = saved(_to_least(_to_least(now, True), False))
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(tied, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def global_order(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with its rows' places (from 0) in the order of ``by``: ranges are ranked apart, and only their sizes are summed in one task.  The result is saved."""
    ranged = saved(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    begins = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_begin"))
    placed = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*by))).join(F.broadcast(begins), "_range")  # a row for each partition
    return saved(placed.withColumn(name, F.col("_begin") + F.col("_own") - 1).drop("_range", "_begin", "_own"))


def _jumped(state: DataFrame) -> DataFrame:
    """state with each event's pointer moved to where the next one's points, and the sums between them."""
    to = state.select(F.col("event").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"), F.col("depth").alias("_depth"), F.col("sound").alias("_sound"))
    ended = F.col("next").isNull()
    either = lambda c: F.when(ended, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    total = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
    return state.join(to, "next", "left").select("event", F.col("_next").alias("next"), total("n"), total("depth"), either("sound"))


def tour(nodes: DataFrame) -> DataFrame:
    """(tree, node, position, depth) of nodes (tree, node, parent, rank), one row for each (tree, node): the walk from a root through its whole
    first branch to the next one, siblings and roots in the order of rank and node.

    The walk is a list of two events for each node, its beginning and its end, that point to the next one.  Pointers double, with the sums of
    beginnings and of levels that they pass, so a tree of n nodes takes the logarithm of 2 n rounds whatever its shape; an event is the next one of one other at
    most, so no join has a hot key.  Nodes that no root reaches have nulls.
    """
    placed = global_order(nodes.select("tree", "node", "parent", "rank"), ["tree", "parent", "rank", "node"], "place")
    groups = placed.groupBy("tree", "parent").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    begin, end = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    none, yes = F.lit(None).cast("long"), F.lit(True)
    link = lambda event, to, sound=yes: F.struct(event.alias("event"), to.alias("next"), sound.alias("sound"))
    above = placed.select("tree", "node", "place").join(groups.where("parent IS NOT NULL").withColumnRenamed("parent", "node"), ["tree", "node"], "left")
    down = above.select(F.when(F.col("first").isNull(), F.array(link(begin("place"), end("place")))).otherwise(F.array(link(begin("place"), begin("first")), link(end("last"), end("place")))).alias("l"))
    # ends that are no last one's go on to the next sibling, those of roots end the walk, those without a node above lead nowhere
    lasts = groups.select(F.col("last").alias("place"), F.lit(True).alias("is_last"))
    beside = placed.join(lasts, "place", "left").where("is_last IS NULL").select(F.array(link(end("place"), begin("place") + 2)).alias("l"))
    tops = groups.where("parent IS NULL").select(F.array(link(end("last"), none)).alias("l"))
    lost = groups.where("parent IS NOT NULL").join(placed.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_anti").select(F.array(link(end("last"), none, F.lit(False))).alias("l"))
    events = down.union(beside).union(tops).union(lost).select(F.explode("l").alias("l")).select("l.*")
    beginning = F.col("event") % 2 == 0
    state = saved(events.select("event", "next", F.when(beginning, 1).otherwise(0).cast("long").alias("n"), F.when(beginning, 1).otherwise(-1).cast("long").alias("depth"), "sound"))
    for _ in range(math.ceil(math.log2(max(2, 2 * placed.count())) / 2)):
        if state.where("next IS NOT NULL").isEmpty():
            break
        state = saved(_jumped(_jumped(state)))
    done = state.where("next IS NULL AND sound AND event % 2 = 0").select((F.col("event") / 2).cast("long").alias("place"), "n", (-F.col("depth")).cast("int").alias("depth"))
    walked = placed.select("tree", "node", "place").join(done, "place")
    whole = walked.groupBy("tree").agg(F.count("*").alias("_all"))
    told = salted(walked, whole, ["tree"], "node", F.lit(SALTS)).select("tree", "node", (F.col("_all") - F.col("n") + 1).alias("position"), "depth")
    return nodes.select("tree", "node").join(told, ["tree", "node"], "left").select("tree", "node", "position", "depth")


#: Nodes of a tree that one task walks.
TREE = 1 << 16


def walk(rows: pa.Table) -> pa.Table:
    """tour of one tree's nodes, by going through it."""
    node, parent, rank = (rows.column(c).to_pylist() for c in ("node", "parent", "rank"))
    below: dict = {}
    for i in sorted(range(len(node)), key=lambda i: (rank[i] is not None, rank[i] or 0, node[i]), reverse=True):
        below.setdefault(parent[i], []).append(i)
    position, depth = [None] * len(node), [None] * len(node)
    left, place = [(i, 0) for i in below.get(None, [])], 0
    while left:
        i, level = left.pop()
        place += 1
        position[i], depth[i] = place, level
        left += [(j, level + 1) for j in below.get(node[i], [])]
    return rows.select(["tree", "node"]).append_column("position", pa.array(position, pa.int64())).append_column("depth", pa.array(depth, pa.int32()))


def orders(nodes: DataFrame, most: int = TREE) -> DataFrame:
    """tour of nodes; a tree of up to ``most`` nodes is walked in one task, larger ones go by doubling."""
    nodes = saved(nodes.select("tree", "node", "parent", "rank"))
    large = nodes.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") > most).select("tree")
    kind = "tree {}, node {}, position long, depth int".format(*(nodes.schema[c].dataType.simpleString() for c in ("tree", "node")))
    if large.isEmpty():
        return nodes.groupBy("tree").applyInArrow(walk, kind)
    large = saved(large)
    return nodes.join(large, "tree", "left_anti").groupBy("tree").applyInArrow(walk, kind).unionByName(tour(nodes.join(large, "tree", "left_semi")))
