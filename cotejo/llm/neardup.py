"""Near-duplicates by SetSketch registers.

A document's set is its distinct shingles.  Each of its registers is a minimum, over the set, of
exponential hashes, truncated to exponentially spaced levels (base BASE): registers of a union are
the element-wise largest, and two sets agree in a register about as often as they are similar.

1. Documents of equal sets are one class, its smallest doc_id its representative.
2. Bands of registers are keys; representatives learn which of their keys others share.
3. In each bucket of a shared key the member that shares most keys is the centre.  Every member is
   paired with the best of its centres; the joint likelihood of the registers drops hopeless pairs and
   the others are verified on their full sets, which gives links and components.
4. Families are what buckets connect.  Where a family falls into several components, every member
   outside its largest one is verified against all members of other components, in blocks, so no
   pair that shares a bucket is left unjudged and no bucket is expanded into pairs.

Rows that meet at one key (a class, bucket, centre or family) are spread over salts of that key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm.exchange import FIND, Answers, bucket_count, keyed_rows, narrow, shared_keys, widen
from cotejo.llm.kernels import LOWER, U64, blocks, mix, run_hash, words
from cotejo.plans.joins import SALTS, salted
from cotejo.plans.saved import saved

BASE, RATE, LEVELS = 1.001, 20.0, 65534
#: Centres that a member is verified against at once; the blocks of families judge what that leaves.
TRIED = 2
#: Members of a block: strays and others.
STRAYS, OTHERS = 256, 2048
#: Rows for each salt where they carry sets.
SALT_ROWS = 1000
#: Links that a task ties at once.
PORTION = 1 << 18


def shingle_sets(batch_text: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than ``size`` are one shingle, none are none."""
    for b in blocks(batch_text):
        w = words(b, fold=LOWER)
        at = np.flatnonzero(w.windows(size))
        h = w.window_hash(at, size)
        cut = np.searchsorted(at, w.first)
        for i in range(b.n):
            low, high = w.first[i], w.first[i + 1]
            if cut[i] < cut[i + 1]:
                yield np.unique(h[cut[i] : cut[i + 1]])
            elif low < high:
                yield run_hash(w.hash[low:high], np.array([0]), int(high - low))
            else:
                yield np.zeros(0, U64)


class Sketch:
    """m registers of a set."""

    def __init__(self, m: int) -> None:
        seeds = mix(np.arange(2 * m, dtype=U64) + U64(7))
        self.m, self.flip, self.times = m, seeds[:m].astype(np.uint32), seeds[m:].astype(np.uint32) | np.uint32(1)

    def minima(self, own: np.ndarray) -> np.ndarray:
        """The least 32-bit hash of the set under each register's function."""
        least = np.full(self.m, 0xFFFFFFFF, np.uint32)
        narrow = own.astype(np.uint32)
        for i in range(0, len(narrow), 64):
            h = narrow[i : i + 64, None] ^ self.flip
            h *= self.times
            np.minimum(least, h.min(axis=0), out=least)
        return least

    def registers(self, own: np.ndarray) -> np.ndarray:
        """Levels of the minima of exponential variables of rate RATE; an empty set has 0."""
        if not len(own):
            return np.zeros(self.m, np.uint16)
        x = -np.log1p(-(self.minima(own).astype(np.float64) + 0.5) / 2**32) / RATE
        return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LEVELS + 1).astype(np.uint16)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of registers."""
    n = len(registers) // rows
    return mix(run_hash(registers.astype(U64), np.arange(n) * rows, rows) + np.arange(n, dtype=U64))


def unlikely(a: np.ndarray, b: np.ndarray, na: int, nb: int, similarity: float) -> bool:
    """Whether the registers' joint likelihood rules the similarity out, given the sizes of the sets.

    a > b, a < b and a = b happen with probabilities p(u - v J), p(v - u J) and the rest, where u and
    v are the sets' shares of na + nb and p(x) = -log(1 - x (BASE - 1) / BASE) / log(BASE).  It does
    if the best J below ``similarity`` is e**14 times as likely.
    """
    u = na / (na + nb)
    v = 1 - u
    top = min(u / v, v / u)
    if top < similarity:
        return True
    counts = np.array([(a > b).sum(), (a < b).sum(), (a == b).sum()])
    j = np.append(np.linspace(0, similarity, 41), np.linspace(similarity, top, 11)[1:])
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    fit = counts @ np.log(np.maximum(np.stack((more, less, 1 - more - less)), 1e-12))
    return fit[:41].max() - fit[40:].max() > 14


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(a: np.ndarray, b: np.ndarray, turn: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the links a - b: the sorted distinct nodes and for each the first one that the links reach, in an order that ``turn`` shuffles (None: the least)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    order = np.arange(len(nodes)) if turn is None else np.argsort(mix(mix(nodes.view(U64)) + U64(turn)), kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    i, j = place[at[: len(a)]], place[at[len(a) :]]
    root = np.arange(len(nodes))
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = low < high
        i, j = i[apart], j[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(root, up := root[root]):
            root = up
    return nodes, nodes[order[root[place]]]


def _portions(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[tuple[np.ndarray, ...]]:
    """The first two columns of the batches, in portions that end once they have ``most`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= most:
            yield tuple(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1))
            held = []
    if sum(map(len, held)):
        yield tuple(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1))


def components(links: DataFrame, most: int = PORTION) -> DataFrame:
    """(node, component) for the nodes of links (a, b), a <> b: the smallest node that links reach.

    The graph is contracted in rounds until it has at most ``most`` links, which one task ties.  In a round, a task ties the nodes of
    each portion of its links to their root, so a node has a row for each portion at most, however many links it has; where a node's
    rows meet, their roots are tied in turn.  Nodes that were no portion's root are settled, the others are the next round's graph.
    Roots are first in an order shuffled anew in each round, so about a third of the nodes of any chain go in a round even where no two
    of its links share a task.  Each round is saved.
    """

    def tie(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, b in _portions(batches, PORTION):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b, turn)], names=["node", "root"])  # a root's own row tells that it is one

        return run

    def meet(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, b in _portions(batches, np.inf):
                nodes, roots = forest(a, b, turn)
                keep = nodes != roots
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (nodes, roots, np.isin(nodes, b))], names=["node", "root", "open"])

        return run

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _portions(batches, np.inf):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b)], names=["node", "root"])

    now, rounds = saved(links.select("a", "b").where("a <> b")), []
    while now.count() > most:
        turn = len(rounds)
        tied = now.mapInArrow(tie(turn), "node long, root long").repartition("node")
        rounds.append(saved(tied.mapInArrow(meet(turn), "node long, root long, open boolean")))
        now = rounds[-1].where("open").select(F.col("node").alias("a"), F.col("root").alias("b"))
    done = saved(now.coalesce(1).mapInArrow(rest, "node long, root long"))
    if not rounds:
        return done.withColumnRenamed("root", "component")
    for part in reversed(rounds):
        further = done.select(F.col("node").alias("root"), F.col("root").alias("end"))
        done = saved(part.where("NOT open").join(further, "root", "left").select("node", F.coalesce("end", "root").alias("root")).union(done))
    done = done.where("node <> root")
    least = done.groupBy("root").agg(F.min("node").alias("least")).select("root", F.least("least", "root").alias("component"))
    return saved(salted(done, least, ["root"], "node", F.lit(SALTS)).select("node", "component").union(least.select(F.col("root").alias("node"), "component")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 64, rows: int = 8) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of each row of docs, which has doc_id (long) and text.

    Shingles are runs of ``size`` words (at white space, A-Z folded).  Two documents are linked if
    100 * intersection >= percent * union of their sets.  class_id is the smallest doc_id of equal
    sets, component_id the smallest that links reach.  A document without words, or with a null text,
    has n_shingles 0 and is in a component of its own; rows without doc_id have null ids.  Repeated
    rows are equal sets; rows that repeat a doc_id with another text keep their own n_shingles, and one
    of them stands for its links.  Other columns are not read.  Links of exactly the least similarity are met
    in no band with a chance of (1 - 0.8**rows)**bands, 8e-6 as given.
    """
    sketch = Sketch(bands * rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ones, twos, keys = [], [], [], []
            for own in shingle_sets(batch.column("text"), size):
                sizes.append(len(own))
                ones.append(int(own.sum(dtype=U64).astype(np.int64)))
                twos.append(int(mix(own).sum(dtype=U64).astype(np.int64)))
                keys.append(narrow(band_keys(sketch.registers(own), rows), FIND) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_shingles", "one", "two", "keys"]
            )

    docs = docs.select("doc_id", "text")
    signed = saved(docs.mapInArrow(sign, "doc_id long, n_shingles long, one long, two long, keys binary"))
    equal = ["n_shingles", "one", "two"]
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*equal).agg(F.min("doc_id").alias("class_id"))
    classes = saved(salted(signed.drop("keys"), classes, equal, "doc_id", F.lit(SALTS), "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")))
    chosen = classes.where("doc_id = class_id AND n_shingles > 0").select("doc_id")

    def keys_of(batch: pa.RecordBatch):
        return widen(b"".join(batch.column("keys").to_pylist()), len(batch) * bands), None, np.repeat(batch.column("doc_id").to_numpy(), bands)

    banded = signed.select("doc_id", "keys").where("keys IS NOT NULL").join(chosen, "doc_id", "left_semi")
    n_buckets = bucket_count(docs)
    shared = shared_keys(keyed_rows(banded, keys_of, False, n_buckets), False, n_buckets)

    def unpack(rows: pa.Table) -> pa.Table:
        found = Answers(rows, FIND)
        own = np.unique(np.rec.fromarrays((found.docs, found.keys)))
        _, which, count = np.unique(own.f0, return_inverse=True, return_counts=True)
        return pa.table({"key": own.f1.astype(np.int64), "doc": own.f0, "degree": count[which]})

    members = saved(shared.groupBy("part").applyInArrow(unpack, "key long, doc long, degree long"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, registers = [], []
            for own in shingle_sets(batch.column("text"), size):
                sets.append(own.tobytes())
                registers.append(sketch.registers(own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary()), pa.array(registers, pa.binary())], names=["doc_id", "set", "registers"])

    sets = saved(docs.join(members.select(F.col("doc").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(contents, "doc_id long, set binary, registers binary"))

    centres = members.groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc")).alias("doc"))).alias("top"), F.count("*").alias("n"))
    centres = centres.where("n > 1").select("key", (-F.col("top.doc")).alias("centre"), F.col("top.degree").alias("weight"), "n")
    pairs = salted(members, centres, ["key"], "doc", F.lit(SALTS)).where("doc <> centre").groupBy(F.col("centre").alias("a"), F.col("doc").alias("b")).agg(F.max("weight").alias("weight"), F.max("n").alias("n"))
    own = Window.partitionBy("b").orderBy(F.col("weight").desc(), "a")  # a row for each band at most
    pairs = saved(pairs.select("a", "b", "n", F.row_number().over(own).alias("best"), F.first("a").over(own).alias("home")))
    links = saved(_verified(pairs.where(F.col("best") <= TRIED).select("a", "b", "n"), sets, percent))
    # a member is tied to its best centre, and that to its others
    families = components(pairs.where("best = 1").select("a", "b").union(pairs.where("best > 1").select("home", "a")))
    members = saved(families.select("node", F.col("component").alias("family")).join(components(links), "node", "left").select("node", "family", F.coalesce("component", "node").alias("component")))
    further = components(_across(members, sets, percent)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    final = salted(members, further, ["component"], "node", F.lit(SALTS), "left").select(F.col("node").alias("class_id"), F.coalesce("whole", "component").alias("component"))
    labelled = salted(classes, final, ["class_id"], "doc_id", F.lit(SALTS), "left")
    return labelled.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links; n tells about how many pairs a is in."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"), F.col("registers").alias("registers_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"), F.col("registers").alias("registers_b"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, ra, rb in zip(*(batch.column(c) for c in ("set_a", "set_b", "registers_a", "registers_b")), strict=True):
                a, b = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
                ra, rb = np.frombuffer(ra.as_buffer(), np.uint16), np.frombuffer(rb.as_buffer(), np.uint16)
                keep.append(not unlikely(ra, rb, len(a), len(b), percent / 100) and alike(a, b, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = salted(pairs.join(right, "b"), left, ["a"], "b", F.ceil(F.col("n") / SALT_ROWS))
    return pairs.select("a", "b", "set_a", "set_b", "registers_a", "registers_b").mapInArrow(judge, "a long, b long")


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of a family, named by the components, from members (node, family, component): each outside the largest one against all others."""
    sizes = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("family").agg(F.max(F.struct("n", (-F.col("component")).alias("component"))).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("size"))
    tops = tops.where("parts > 1").select("family", (-F.col("top.component")).alias("largest"), (F.col("size") - F.col("top.n")).alias("strays"), "size")
    members = salted(members, tops, ["family"], "node", F.lit(SALTS)).withColumn("stray", F.col("component") != F.col("largest"))
    members = members.join(sets.select(F.col("doc_id").alias("node"), "set"), "node")
    row = F.ceil(F.col("strays") / STRAYS).cast("int")
    column = F.ceil(F.col("size") / OTHERS).cast("int")
    spot = F.hash("node")
    strays = members.where("stray").select("family", F.pmod(spot, row).alias("i"), F.explode(F.sequence(F.lit(0), column - 1)).alias("j"), "node", "component", "set", F.lit(True).alias("asks"))
    others = members.select("family", F.explode(F.sequence(F.lit(0), row - 1)).alias("i"), F.pmod(spot, column).alias("j"), "node", "component", "set", F.lit(False).alias("asks"))

    def block(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy()
        parts = rows.column("component").to_numpy()
        own = [np.frombuffer(s.as_buffer(), U64) for chunk in rows.column("set").chunks for s in chunk]
        told, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
        flat = np.concatenate([own[i] for i in told]) if len(told) else np.zeros(0, U64)
        sizes = np.array([len(own[i]) for i in told], np.int64)
        owner = np.repeat(np.arange(len(told)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        a, b = [], []
        for i in asking:
            low, high = np.searchsorted(flat, own[i], "left"), np.searchsorted(flat, own[i], "right")
            n = high - low
            at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(told))
            hit = (100 * both >= percent * (sizes + len(own[i]) - both)) & (parts[told] != parts[i])
            _, one = np.unique(parts[told[hit]], return_index=True)  # a link to each component is enough
            for j in told[hit][one]:
                a.append(parts[i])
                b.append(parts[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return strays.unionByName(others).groupBy("family", "i", "j").applyInArrow(block, "a long, b long")
