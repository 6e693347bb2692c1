"""Vectorised byte and word helpers that the operators run inside their Spark tasks.

Texts are handled as the contiguous UTF-8 buffer of an Arrow column, cut into blocks of whole
documents of about ``BLOCK`` bytes; a longer document is a block of its own, so memory follows the
longest document, not the batch.  A null text has no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

BLOCK = 1 << 18
U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _space_table() -> np.ndarray:
    """True for bytes of words split at ASCII white space."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def _alnum_table() -> np.ndarray:
    """True for digits, a-z, A-Z (lower-cased by LOWER) and every byte of a non-ASCII character."""
    table = np.zeros(256, bool)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = True
    return table


WORD_BYTES = _space_table()
ALNUM_BYTES = _alnum_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 1)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, U64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=U64))
        have = _powers[base] = (tables[0], tables[1])
    return have


def gram_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values: a polynomial modulo 2**64 from prefix sums, finalised.

    Only to choose and to find: chosen texts collide, so what is found is decided by other means.
    """
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _powers_of(_BASES[1], len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n])


#: Random values for each place and value of a byte; places beyond it take factors besides.
_PLACES = 64
_TABLE = mix(mix(np.arange(_PLACES * 256, dtype=U64) + U64(_BASES[0])) ^ U64(_BASES[2]))


def _factors_of(at: np.ndarray) -> np.ndarray:
    """An odd factor of its own for each number."""
    return mix(mix(at.astype(U64) + U64(_BASES[1])) ^ U64(_BASES[3])) | U64(1)


def _portions(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of the spans of about BLOCK bytes, so that what is made for each byte stays small."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK)))
        yield slice(i, j)
        i = j


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of non-empty spans, one after another, its place in the span; and where each span begins among them."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(first, sizes), first


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] (bytes) for each span: a sum of random values, one for each byte at its place in the span.

    Two different spans collide with a chance of 2**-64 whatever they say, since each place has values of its own.
    """
    sizes = ends - starts
    out = np.zeros(len(sizes), U64)
    some = np.flatnonzero(sizes > 0)
    for part in _portions(sizes[some]):
        which = some[part]
        place, first = _places(sizes[which])
        own = data[place + np.repeat(starts[which], sizes[which])]
        if int(sizes[which].max()) <= _PLACES:
            terms = _TABLE[(place << 8) + own]
        else:
            terms = _TABLE[((place & _PLACES - 1) << 8) + own]
            far = np.flatnonzero(place >= _PLACES)
            terms[far] *= _factors_of(place[far] // _PLACES)
        out[which] = np.add.reduceat(terms, first)
    return mix(out + sizes.astype(U64) * U64(_BASES[3]))


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] and data[b:b+size] are the same bytes, for each."""
    out = np.ones(len(sizes), bool)
    some = np.flatnonzero((sizes > 0) & (a != b))
    for part in _portions(sizes[some]):
        which = some[part]
        place, first = _places(sizes[which])
        out[which] = np.logical_and.reduceat(data[place + np.repeat(a[which], sizes[which])] == data[place + np.repeat(b[which], sizes[which])], first)
    return out


def run_hash(values: np.ndarray, at: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of the k hashes values[i:i+k] for each i of at: a sum with random odd factors, one for each place."""
    factors = mix(mix(np.arange(k, dtype=U64) + U64(_BASES[2])) ^ U64(_BASES[lane])) | U64(1)
    begin = k * _BASES[3] & (1 << 64) - 1
    n = len(values) - k + 1
    if len(at) * 3 > n:  # most places are asked for
        out = np.full(max(0, n), begin, U64)
        for j in range(k):
            out += values[j : j + n] * factors[j]
        return mix(out[at])
    out = np.full(len(at), begin, U64)
    for j in range(k):
        out += values[at + j] * factors[j]
    return mix(out)


@dataclass
class Block:
    """Consecutive documents: bytes, their offsets, and the batch index of the first."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array) -> Iterator[Block]:
    """Blocks of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    n, at = len(column), column.offset
    if not n:
        return
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1 + at)[at:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        j = min(j, n)
        yield Block(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


@dataclass
class Words:
    """Words of a block: byte spans, 64-bit hashes, and for each document its first word's index."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    hash: np.ndarray | None
    data: np.ndarray

    def windows(self, k: int) -> np.ndarray:
        """True at words where a window of k words of one document starts."""
        ok = np.zeros(len(self.starts), bool)
        if len(ok) >= k:
            ok[: len(ok) - k + 1] = self.doc[: len(ok) - k + 1] == self.doc[k - 1 :]
        return ok

    def window_hash(self, at: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
        return run_hash(self.hash, at, k, lane)


def words(block: Block, table: np.ndarray = WORD_BYTES, fold: np.ndarray = SAME, hashed: bool = True) -> Words:
    data, offsets = block.data, block.offsets
    if fold is not SAME:
        data = fold[data]
    inside = table[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(block.n), np.diff(first))
    return Words(starts, ends, first, doc, span_hash(data, starts, ends) if hashed else None, data)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """True at 0..n-1 inside any [start, start+k)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + k, n), -1)
    return np.cumsum(edge[:n]) > 0


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (by doubling)."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def extended(schema: T.StructType, *added: str) -> T.StructType:
    """The schema with fields added, each as "name type"."""
    return T.StructType(schema.fields + T._parse_datatype_string(", ".join(added)).fields)


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores added until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
