"""Finding keys that several documents hold, without a row per key.

A task packs the keys of its batch into one row for each bucket of the key space (arrays of keys
and of document ids).  Spark shuffles the rows by bucket; a bucket finds which keys several
documents hold and packs its answers into one row for each part of the documents, where they meet
the texts again.  A key that many documents hold costs one entry for each batch: within a batch only
its smallest document goes to the bucket, and the others, already known to share it, are answered at
once.  So one hot key, a third of all rows say, never meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cotejo.llm.kernels import U64

#: docs are offsets from base; every array is packed in as few bytes a value as its largest needs.
REQUEST = "bucket int, n int, keys binary, more binary, docs binary, base long, known boolean"
ANSWER = "part int, n int, keys binary, docs binary, base long"
_REQUEST = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("docs", pa.binary()), ("base", pa.int64()), ("known", pa.bool_())])
_ANSWER = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("base", pa.int64())])
#: Parts of the documents for each shuffle partition, so that partitions are even.
PER_PARTITION = 2
#: Bytes of texts for each bucket.
BUCKET_BYTES = 128 << 20
#: Keys already answered travel in rows of so many.
KNOWN_ROW = 1 << 16
#: Bytes of a key that are sent: FIND to find candidates, DECIDE and MORE to decide.
FIND, DECIDE, MORE = 6, 8, 4


def bucket_count(df: DataFrame) -> int:
    """A bucket for each of the session's shuffle partitions, and at least one for each BUCKET_BYTES of df's texts, which are summed."""
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), size // BUCKET_BYTES)


def part_count(n_buckets: int) -> int:
    return PER_PARTITION * n_buckets + 1


def part_of(docs: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of each document; part_column says the same in Spark."""
    d = docs.astype(U64)
    return ((d ^ d >> U64(32) ^ d >> U64(16) ^ d >> U64(8)) % U64(n_parts)).astype(np.int64)


def part_column(n_parts: int) -> Column:
    """The part of a row by its doc_id, and by its text where that is null."""
    d = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    folded = d.bitwiseXOR(F.shiftrightunsigned(d, 32)).bitwiseXOR(F.shiftrightunsigned(d, 16)).bitwiseXOR(F.shiftrightunsigned(d, 8))
    # unsigned remainder: of the upper 63 bits and the lowest one
    high, low = F.shiftrightunsigned(folded, 1), folded.bitwiseAND(F.lit(1).cast("long"))
    return ((high % n_parts * 2 + low) % n_parts).cast("int")


def low_bytes(width: int) -> np.uint64:
    return U64((1 << 8 * width) - 1)


def narrow(values: np.ndarray, width: int | None = None) -> bytes:
    """The low ``width`` bytes of each 64-bit value; None: as many as the largest needs."""
    if width is None:
        width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(packed: bytes, n: int) -> np.ndarray:
    """The n values that narrow packed."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(packed) // n] = np.frombuffer(packed, np.uint8).reshape(n, -1)
    return out.reshape(-1).view(U64)


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    if len(values):
        cut = np.flatnonzero(values[1:] != values[:-1]) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), len(values)], strict=True)


def _offsets(docs: np.ndarray) -> tuple[bytes, int]:
    base = int(docs.min())
    return narrow((docs - base).astype(U64)), base


def requests(keys: np.ndarray, more: np.ndarray | None, docs: np.ndarray, n_buckets: int, later_only: bool) -> pa.RecordBatch:
    """Rows for one batch.  keys, more: two hashes of each key, of which DECIDE and MORE bytes count (more None: FIND of the first); docs: their documents."""
    width = FIND if more is None else DECIDE
    keys = keys & low_bytes(width)
    more = more & low_bytes(MORE) if more is not None else np.zeros(len(keys), U64)
    order = np.lexsort((docs, more, keys))
    keys, more, docs = keys[order], more[order], docs[order]
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (more[1:] == more[:-1])
    repeat = same.copy()
    repeat[1:] &= docs[1:] == docs[:-1]
    keys, more, docs = keys[~repeat], more[~repeat], docs[~repeat]
    known = np.zeros(len(keys), bool)
    known[1:] = (keys[1:] == keys[:-1]) & (more[1:] == more[:-1])
    if not later_only:  # the smallest holder is known to share the key too
        also = np.flatnonzero(known[1:] & ~known[:-1])
        keys, more, docs = (np.concatenate((x, x[also])) for x in (keys, more, docs))
        known = np.concatenate((known, np.ones(len(also), bool)))
    bucket = (keys % U64(n_buckets)).astype(np.int64)
    # known keys go in a few rows to any bucket; the first holder of each key goes to the key's bucket
    part = bucket * 2
    at = np.flatnonzero(known)
    for i in range(0, len(at), KNOWN_ROW):
        part[at[i : i + KNOWN_ROW]] = bucket[at[i]] * 2 + 1
    order = np.argsort(part, kind="stable")
    rows: dict[str, list] = {name: [] for name in _REQUEST.names}
    for i, j in runs(part[order]):
        at, told = order[i:j], bool(part[order[i]] & 1)
        off, base = _offsets(docs[at])
        for name, value in zip(rows, (int(part[at[0]] >> 1), len(at), narrow(keys[at], width), narrow(more[at], MORE) if width == DECIDE and not told else None, off, base, told), strict=True):
            rows[name].append(value)
    return pa.RecordBatch.from_pydict(rows, schema=_REQUEST)


def keyed_rows(df: DataFrame, keys_of: Callable, later_only: bool, n_buckets: int) -> DataFrame:
    """The packed rows of all batches of df; keys_of(batch) -> (keys, more, docs)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, more, docs = keys_of(batch)
            if len(keys):
                yield requests(keys, more, docs, n_buckets, later_only)

    return df.mapInArrow(pack, REQUEST)


def shared_keys(requested: DataFrame, later_only: bool, n_buckets: int) -> DataFrame:
    """Answers, packed by part of the documents: which of its keys each document shares.

    later_only: keys that a document with a smaller id holds, decided by DECIDE + MORE bytes; otherwise
    every key with another holder, found by FIND bytes.  Give ``keyed_rows`` the same values.
    """
    width = DECIDE if later_only else FIND
    n_parts = part_count(n_buckets)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for n, keys, more, docs, base, known in zip(*(batch.column(c).to_pylist() for c in ("n", "keys", "more", "docs", "base", "known")), strict=True):
                parts.append((widen(keys, n), widen(more, n) if more is not None else np.zeros(n, U64), widen(docs, n).astype(np.int64) + base, np.full(n, known)))
        if not parts:
            return
        keys, more, docs, known = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        done_keys, done_docs = keys[known], docs[known]
        keys, more, docs = keys[~known], more[~known], docs[~known]
        order = np.lexsort((docs, more, keys))
        keys, more, docs = keys[order], more[order], docs[order]
        if len(keys):
            same = np.concatenate(([False], (keys[1:] == keys[:-1]) & (more[1:] == more[:-1])))
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))
            told = docs > docs[first]
            if not later_only:  # the smallest holder hears of it too, when there is another
                told[first[told]] = True
            done_keys, done_docs = np.concatenate((done_keys, keys[told])), np.concatenate((done_docs, docs[told]))
        part = part_of(done_docs, n_parts)
        order = np.argsort(part, kind="stable")
        rows: dict[str, list] = {name: [] for name in _ANSWER.names}
        for i, j in runs(part[order]):
            at = order[i:j]
            off, base = _offsets(done_docs[at])
            for name, value in zip(rows, (int(part[at[0]]), len(at), narrow(done_keys[at], width), off, base), strict=True):
                rows[name].append(value)
        yield pa.RecordBatch.from_pydict(rows, schema=_ANSWER)

    return requested.repartitionById(n_buckets, "bucket").mapInArrow(resolve, ANSWER)


class Answers:
    """The shared keys of one part's documents."""

    def __init__(self, rows: pa.Table, width: int) -> None:
        found = [(widen(d, n).astype(np.int64) + base, widen(k, n)) for n, k, d, base in zip(*(rows.column(c).to_pylist() for c in ("n", "keys", "docs", "base")), strict=True)]
        docs = np.concatenate([d for d, _ in found]) if found else np.zeros(0, np.int64)
        keys = np.concatenate([k for _, k in found]) if found else np.zeros(0, U64)
        order = np.argsort(docs, kind="stable")
        self.docs, self.keys, self.width = docs[order], keys[order], width

    def of(self, doc: int | None) -> np.ndarray:
        if doc is None:
            return self.keys[:0]
        low, high = np.searchsorted(self.docs, (doc, doc + 1))
        return self.keys[low:high]

    def has(self, own: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """True for the keys that ``own``, a document's answer, holds."""
        return np.isin(keys & low_bytes(self.width), own)


def parted(docs: DataFrame, name: str, n_buckets: int) -> DataFrame:
    """docs with the column ``name``, the part of each row."""
    return docs.withColumn(name, part_column(part_count(n_buckets)))


def with_answers(docs: DataFrame, part: str, answers: DataFrame, later_only: bool, work: Callable[[pa.Table, Answers], pa.Table], schema: str | StructType) -> DataFrame:
    """work(rows, answers) for each part of the documents (``parted``, in the column part) and what was found for them."""

    def meet(rows: pa.Table, found: pa.Table) -> pa.Table:
        return work(rows.combine_chunks(), Answers(found, DECIDE if later_only else FIND))

    return docs.groupBy(part).cogroup(answers.groupBy("part")).applyInArrow(meet, schema)
