"""Similar strings of two sides: an exact join on rare pairs of letters.

Two strings of m and n letters whose Indel ratio is r have at most (1 - r)(m + n) letters that are not common.  A letter
without partner breaks two pairs of neighbours of its own string, and one of the other's, so at least
(m + n) / 2 - 1 - 1.5 (1 - r)(m + n) pairs of neighbours are common, in the same order.  So of each string's pairs,
sorted from the rarest on, the rarest common one is among the first that could be broken and one more: these are
the keys of the join.  What meets at a key has to have enough letters, pairs of letters and at last a long enough common
subsequence.  Strings so short that no pair of letters need be common meet at their letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.similarity import codes_of, common_lengths
from cotejo.plans.joins import SALTS, salted
from cotejo.plans.saved import saved

#: Strings of a side that meet at once at a key, and pairs that are compared at once.
MEET, PAIRS = 2048, 1 << 18
#: Rows that a task looks at together.
TASK_ROWS = 1 << 16
#: The largest share of letters without partner.
MOST_SLACK = 0.3
#: Bits of a string's letters and of its pairs of letters.
LETTER_BITS, PAIR_BITS = 256, 1024


def _broken(size: Column, slack: Column) -> Column:
    """How many pairs of letters of a string of that size can be broken, whatever the other one's size."""
    shortest = size * (1 - slack) / (1 + slack)
    return F.floor(((3 * slack + 1) * size + (3 * slack - 1) * shortest) / 2 + 1e-6).cast("int")


def _short(slack: Column | float) -> Column | float:
    """The largest m + n at which no pair of letters need be common."""
    return 1 / (0.5 - 1.5 * slack) + 1e-6


def _keys(side: DataFrame) -> DataFrame:
    """side with gram: a row for each pair of letters, and for each letter of the short ones."""
    pairs = F.when(F.col("size") > 1, F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda i: F.substr("word", i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    letters = F.when(F.col("size") < _short(F.col("slack")), F.array_distinct(F.split("word", ""))).otherwise(F.array().cast("array<string>"))
    return side.select("block", "id", "size", "slack", pairs.alias("pairs"), F.filter(letters, lambda c: c != "").alias("letters"))


def prefixes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(block, own, id, gram) of both sides (own: whether of the left one): the keys at which a string has to meet all that could be similar."""
    both = _keys(left).withColumn("own", F.lit(True)).unionByName(_keys(right).withColumn("own", F.lit(False)))
    spread = both.where(F.size("pairs") > 0).select("block", "own", "id", "size", "slack", F.explode("pairs").alias("gram"))
    frequency = spread.groupBy("block", "gram").agg(F.count("*").alias("n"))
    counted = salted(spread.withColumn("spot", F.xxhash64("own", "id")), frequency, ["block", "gram"], "spot", F.lit(SALTS))
    ordered = counted.groupBy("block", "own", "id").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"), F.first("size").alias("size"), F.first("slack").alias("slack"))
    rare = ordered.select("block", "own", "id", F.explode(F.array_distinct(F.slice("grams.gram", F.lit(1), _broken(F.col("size"), F.col("slack")) + 1))).alias("gram"))
    return rare.unionByName(both.select("block", "own", "id", F.explode("letters").alias("gram")))


def _bits(hashes: np.ndarray, there: np.ndarray, n_bits: int) -> np.ndarray:
    """A row of bits for each string: those of its hashes that are there."""
    out = np.zeros((len(hashes), n_bits // 64), np.uint64)
    own = np.arange(len(hashes))
    for j in range(hashes.shape[1]):
        h = hashes[:, j] % np.uint64(n_bits)
        out[own, (h >> np.uint64(6)).astype(np.int64)] |= np.where(there[:, j], np.uint64(1) << (h & np.uint64(63)), np.uint64(0))
    return out


class Strings:
    """Distinct strings of some rows: sizes and bits; ``of`` has each row's string."""

    def __init__(self, words: pa.ChunkedArray) -> None:
        coded = words.combine_chunks().dictionary_encode()
        self.of, self.word = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        codes = codes_of(self.word).astype(np.uint64)
        self.size = np.array([len(w) for w in self.word])
        there = np.arange(codes.shape[1]) < self.size[:, None]
        spread = codes * np.uint64(0x9E3779B97F4A7C15)
        self.letters = _bits(spread >> np.uint64(40), there, LETTER_BITS)
        two = (spread[:, :-1] * np.uint64(3) + spread[:, 1:]) * np.uint64(0xD6E8FEB86659FD93)
        self.pairs = _bits(two >> np.uint64(40), there[:, 1:], PAIR_BITS)
        # how many of each have no bit of their own
        self.more_letters = self.size - np.bitwise_count(self.letters).sum(1)
        self.more_pairs = np.maximum(self.size - 1, 0) - np.bitwise_count(self.pairs).sum(1)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(a[:, w] & b[:, w]).astype(np.int64) for w in range(a.shape[1]))


def _could(s: Strings, o: np.ndarray, d: np.ndarray, mods: np.ndarray, tails: np.ndarray, slack: float, gram: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows o and d, in pairs, whose sizes, letters and pairs of letters allow the ratio of 1 - slack, with equal mods and no different tails."""
    b, size_d = s.of[d], s.size[s.of[d]]
    for low in range(0, len(o), step := max(1, PAIRS // max(1, len(d)))):
        own = o[low : low + step]
        total = s.size[s.of[own]][:, None] + size_d[None, :]
        near = np.abs(total - 2 * size_d[None, :]) <= slack * total + 1e-6
        if len(gram) == 1:
            near &= total <= _short(slack)
        near &= mods[own][:, None] == mods[d][None, :]
        if tails[own].any() and tails[d].any():
            near &= (tails[own][:, None] == tails[d][None, :]) | (tails[own][:, None] == 0) | (tails[d][None, :] == 0)
        i, j = np.nonzero(near)
        a = s.of[own]
        for bits, more, needed in (("letters", "more_letters", lambda n: (1 - slack) * n / 2), ("pairs", "more_pairs", lambda n: n / 2 - 1 - 1.5 * slack * n)):
            x, y = a[i], b[j]
            hit = _common(getattr(s, bits)[x], getattr(s, bits)[y]) + getattr(s, more)[x] >= needed(s.size[x] + s.size[y]) - 1e-6
            i, j = i[hit], j[hit]
        yield own[i], d[j]


def _alike(rows: pa.Table, spot: list[str]) -> pa.RecordBatch:
    """(o_id, d_id) of the pairs that meet at a spot and are similar; rows are sorted by spot."""
    none = np.zeros(0, np.int64)
    s = Strings(rows.column("word"))
    own, ids, slack, grams = (rows.column(c).to_numpy() for c in ("own", "id", "slack", "gram"))
    mods, tails = rows.column("mods").to_numpy(), rows.column("tail").to_numpy()
    new = np.zeros(len(own), bool)
    for c in spot:
        values = rows.column(c).combine_chunks()
        values = values.dictionary_encode().indices.to_numpy() if pa.types.is_string(values.type) else values.to_numpy()
        new[1:] |= values[1:] != values[:-1]
    cut = [0, *np.flatnonzero(new).tolist(), len(own)]
    found = [(none, none)]
    for low, high in zip(cut[:-1], cut[1:], strict=True):
        left = own[low:high]
        if left.any() and not left.all():
            found += _could(s, low + np.flatnonzero(left), low + np.flatnonzero(~left), mods, tails, slack[low], grams[low])
    o, d = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    _, first = np.unique(np.stack((ids[o], ids[d], slack[o].view(np.int64))), axis=1, return_index=True)
    o, d = o[first], d[first]
    a, b = s.of[o], s.of[d]
    hit = common_lengths([s.word[k] for k in a.tolist()], [s.word[k] for k in b.tolist()]) >= (1 - slack[o]) * (s.size[a] + s.size[b]) / 2 - 1e-6
    return pa.RecordBatch.from_arrays([pa.array(ids[o[hit]]), pa.array(ids[d[hit]])], names=["o_id", "d_id"])


def similar_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(o_id, d_id), once each: pairs of equal block whose Indel ratio is at least 1 - slack, with equal mods and no different tails.

    Both have block (string), id (long, one for each row), word (string), slack (double, one for each block, up to MOST_SLACK), mods
    and tail (long; a tail of 0 is none).  Empty and null words are similar to nothing.  A key that very many strings have
    is dealt out in squares of MEET by MEET strings, so no task holds more of it.
    """
    left, right = (saved(side.where("word <> ''").withColumn("size", F.length("word"))) for side in (left, right))
    keys = saved(prefixes(left, right))
    counts = keys.groupBy("block", "gram").agg(F.count_if("own").alias("n_o"), F.count_if(~F.col("own")).alias("n_d")).where("n_o > 0 AND n_d > 0")
    squares = counts.select("block", "gram", F.ceil(F.col("n_o") / MEET).cast("int").alias("rows"), F.ceil(F.col("n_d") / MEET).cast("int").alias("columns"))
    placed = salted(keys.withColumn("spot", F.xxhash64("own", "id")), squares, ["block", "gram"], "spot", F.lit(SALTS))
    across = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    o = placed.where("own").withColumn("i", F.pmod(F.xxhash64("id"), F.col("rows")).cast("int")).withColumn("j", F.explode(across("columns"))).join(left.drop("size"), ["block", "id"])
    d = placed.where("NOT own").withColumn("j", F.pmod(F.xxhash64("id"), F.col("columns")).cast("int")).withColumn("i", F.explode(across("rows"))).join(right.drop("size"), ["block", "id"])
    spot = ["block", "gram", "i", "j"]
    rows = o.unionByName(d).select(*spot, "own", "id", "word", "slack", "mods", "tail")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held is not None else []), batch])
            if len(held) < TASK_ROWS:
                continue
            last = held.slice(len(held) - 1, 1).select(spot).to_pylist()[0]  # whose rows may go on
            keep = len(held) - 1
            tail = held.slice(max(0, keep - 2 * MEET)).select(spot).to_pylist()
            while keep > 0 and tail and tail.pop() == last:
                keep -= 1
            if keep > 0:
                yield _alike(held.slice(0, keep + 1), spot)
                held = held.slice(keep + 1)
        if held is not None and len(held):
            yield _alike(held, spot)

    met = rows.repartition(*spot).sortWithinPartitions(*spot).mapInArrow(meet, "o_id long, d_id long")
    return met.distinct()
