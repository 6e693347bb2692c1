"""Audit of filters that are applied one after another, in every order, by packed bitmaps.

A partition sorts its rows by part and packs one bitset for each filter (rows that fail it) and label; a part's
bitset is a run of whole bytes, so parts are aligned.  For every set of filters that can come first, the rows
that survive it are the AND-NOT of its bitsets; their ones are counted for each part, alone and with each label.
Counts of partitions are summed, and what a filter does at a step of an order follows from the counts of the set
before it and the set with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm.exact import exact_copies
from cotejo.llm.kernels import WORD_BYTES, blocks, equal_spans, free_name, words
from cotejo.llm.quality import _repeats
from cotejo.plans.saved import saved

FILTERS = "ABCDE"
#: The signs that filter D looks for; fewest words; shares (of 100) of distinct words and of capitals.
SIGNS, LEAST_WORDS, DISTINCT, CAPITALS = b"#$%&*|", 50, 65, 5
#: Rows of a packed index, and parts whose counts a task holds.
ROWS, PARTS = 1 << 16, 1 << 14
_SIGN = np.isin(np.arange(256), list(SIGNS))
_CAPITAL = np.isin(np.arange(256), np.arange(0x41, 0x5B))


def text_failures(docs: DataFrame, name: str = "failed") -> DataFrame:
    """docs (with text) and the column name (int): bits 0 to 3 are set where filters A to D reject the text.

    A: under LEAST_WORDS words.  B: 100 * distinct words < DISTINCT * words.  C: 100 * characters A-Z > CAPITALS *
    code points.  D: a sign of SIGNS.  Words are split at ASCII white space; null is the empty text.
    """
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for b in blocks(batch.column("text")):
                w, data = words(b, WORD_BYTES), b.data
                total = np.diff(w.first)
                size = w.ends - w.starts
                same = lambda i, j: (size[i] == size[j]) & equal_spans(data, w.starts[i], w.starts[j], np.where(size[i] == size[j], size[i], 0))  # noqa: E731, B023
                earlier, _ = _repeats(w.hash, w.doc, same)
                distinct = total - np.bincount(w.doc[earlier], minlength=b.n)
                per_text = lambda hit: np.diff(np.concatenate(([0], np.cumsum(hit)))[b.offsets])  # noqa: E731, B023
                points = per_text((data & 0xC0) != 0x80)
                fails = (total < LEAST_WORDS, 100 * distinct < DISTINCT * total, 100 * per_text(_CAPITAL[data]) > CAPITALS * points, per_text(_SIGN[data]) > 0)
                bits.append(sum(f.astype(np.int32) << i for i, f in enumerate(fails)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int32), pa.int32())], names=[*columns, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0)).schema)


def survivors(failed: np.ndarray, labels: list[np.ndarray], part: np.ndarray, n_filters: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts (codes, sorted) and, for each, counts[set of filters, 0 or 1 + label] of the rows that no filter of the set rejects."""
    order = np.argsort(part, kind="stable")
    codes, begin, sizes = np.unique(part[order], return_index=True, return_counts=True)
    width = (sizes + 7) // 8  # bytes of a part
    first = np.cumsum(width) - width
    at = np.arange(len(order)) - np.repeat(begin, sizes) + np.repeat(first * 8, sizes)
    n_bytes = int(width.sum())

    def packed(rows: np.ndarray) -> np.ndarray:
        bits = np.zeros(n_bytes * 8, bool)
        bits[at] = rows[order]
        return np.packbits(bits)

    own = packed(np.ones(len(order), bool))
    wanted = [own, *[packed(x) for x in labels]]
    rejects = [packed((failed >> i & 1).astype(bool)) for i in range(n_filters)]
    counts = np.zeros((len(codes), 1 << n_filters, len(wanted)), np.int64)
    left = {0: own}
    for s in range(1 << n_filters):
        if s:  # the set without its last filter came before
            last = s.bit_length() - 1
            left[s] = left[s & ~(1 << last)] & ~rejects[last]
        for k, which in enumerate(wanted):
            counts[:, s, k] = np.add.reduceat(np.bitwise_count(left[s] & which).astype(np.int64), first) if len(codes) else 0
    return codes, counts


def bitmap_counts(rows: DataFrame, n_filters: int) -> DataFrame:
    """(part, s, n, good, toxic): rows of each part that no filter of the set s (bits) rejects, of them those with a label; rows has part, failed (int), good and toxic (boolean)."""
    sets = 1 << n_filters

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            parts, sums = list(held), np.concatenate([held[p] for p in held]) if held else np.zeros((0, 3), np.int64)
            held.clear()
            columns = [pa.array([p for p in parts for _ in range(sets)], pa.string()), pa.array(np.tile(np.arange(sets, dtype=np.int32), len(parts))), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(3))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "s", "n", "good", "toxic"])

        for batch in batches:
            for i in range(0, len(batch), ROWS):
                some = batch.slice(i, ROWS)
                part = some.column("part").dictionary_encode()
                codes, counts = survivors(some.column("failed").to_numpy(), [some.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic")], part.indices.to_numpy(), n_filters)
                for code, own in zip(codes.tolist(), counts, strict=True):
                    name = part.dictionary[code].as_py()
                    held[name] = held[name] + own if name in held else own
                if len(held) > PARTS:
                    yield told()
        yield told()

    counted = rows.select("part", "failed", "good", "toxic").mapInArrow(count, "part string, s int, n long, good long, toxic long")
    return counted.groupBy("part", "s").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def steps(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step, set before, filter) of each step of each order of the filters."""
    out = []
    for order in permutations(range(len(names))):
        before = 0
        for k, f in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), k, before, f))
            before |= 1 << f
    return out


def interactions(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row for each part, filter_order and step (int): kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (long), of bitmap_counts.

    The filter is the order's letter of that step.  It removes what it rejects of the rows that are left; redundant is
    what it rejects of those that are gone; unique_fails what no other filter rejects; shapley what it removes, summed
    over all orders.
    """
    everything = (1 << len(names)) - 1
    order, step, before, which = zip(*steps(names), strict=True)
    before, which = np.array(before), np.array(which)
    after = before | 1 << which
    alone = 1 << which
    added = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, good, toxic in zip(batch.column("part").to_pylist(), *(batch.column(c).to_pylist() for c in ("n", "good", "toxic")), strict=True):
                n, good, toxic = np.array(n), np.array(good), np.array(toxic)
                removed = n[before] - n[after]
                own = {"kept": n[after], "removed": removed, "redundant": n[0] - n[alone] - removed, "unique_fails": n[everything & ~alone] - n[everything], "good_lost": good[before] - good[after], "toxic_lost": toxic[before] - toxic[after]}
                own["shapley"] = np.bincount(which, removed, len(names)).astype(np.int64)[which]
                columns = [pa.array([part] * len(order), pa.string()), pa.array(order, pa.string()), pa.array(step, pa.int32()), *(pa.array(own[c], pa.int64()) for c in added)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *added])

    sets = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", "n", "good", "toxic"))).alias("c"))  # as many as there are sets of filters
    return sets.select("part", *[F.col(f"c.{c}").alias(c) for c in ("n", "good", "toxic")]).mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in added)}")


def failures(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """(part, failed, good, toxic) of each row of docs: bits of filters A to E, and whether labels say quality 1 or toxic 1 of its doc_id."""
    few = docs.select("doc_id", F.coalesce(part.cast("string"), F.lit("")).alias("part"), "text")
    bits = free_name(few.columns, "bits")
    copies = exact_copies(text_failures(few, bits), largest=False)
    again = F.coalesce(F.col("doc_id") > F.col("keep_id"), F.lit(False))
    judged = copies.select("doc_id", "part", F.col(bits).bitwiseOR(F.when(again, 16).otherwise(0)).alias("failed"))
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    joined = judged.join(told, "doc_id", "left")
    return joined.select("part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: Column | str = "source") -> DataFrame:
    """interactions of filters A to E on docs, for each part.

    docs has doc_id (long), text and what ``part`` reads, labels doc_id, quality and toxic.  A to D are text_failures; E
    rejects a text that a row with a smaller doc_id has, anywhere in the table.  A null text is empty, a null
    part ''; a row without doc_id has no label and isn't rejected by E.  Repeated rows count each for
    itself, and none of equal doc_ids is E's; labels that repeat a doc_id hold if one of them does.  An empty table gives an empty one.
    """
    part = F.col(part) if isinstance(part, str) else part
    return interactions(saved(bitmap_counts(failures(docs, labels, part), len(FILTERS))))
