"""Sum-of-squares online packing of tokenised documents.

Each partition packs its documents as they come.  A level array counts its partly filled windows by
fill; a piece goes to the level (or to a new window) for which the sum of squared counts afterwards
is least, which keeps the levels even and so leaves partners for later pieces.  A document of a
window or more is cut into full windows and a rest.  When the partition ends, the emptiest windows
are cut up to fill the fullest, so at most one window of each partition is padded.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cotejo.llm.kernels import LOWER, U64, Block, Words, blocks, equal_spans, span_hash, words

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Texts that must have the ids of their parts.
SAMPLES = [("One TWO, three!", ["one", "two", ",", "three", "!"]), ("\u00c9t\u00e9\n\nword; a?", ["\u00c9t\u00e9", "word", ";", "a", "?"])]
#: Words remembered by a worker process, about 200 bytes each; beyond it the memory starts afresh.
REMEMBERED = 1_000_000
_MARKS = np.isin(np.arange(256), list(b".,;:!?"))
_LETTERS = (np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A)
_remembered: dict[str, WordTokens] = {}


def units(b: Block) -> Words:
    """Words of a block, A-Z folded; a mark that ends a word behind a letter a-z is a unit of its own."""
    w = words(b, fold=LOWER, hashed=False)
    long = np.flatnonzero(w.ends - w.starts > 1)
    at = long[_MARKS[w.data[w.ends[long] - 1]] & _LETTERS[w.data[w.ends[long] - 2]]]
    starts = np.insert(w.starts, at + 1, w.ends[at] - 1)
    cut = w.ends.copy()
    cut[at] -= 1
    ends = np.insert(cut, at + 1, w.ends[at])
    first = w.first + np.searchsorted(at, w.first)
    return Words(starts, ends, first, np.repeat(np.arange(b.n), np.diff(first)), span_hash(w.data, starts, ends), w.data)


def _same_units(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """A unit of each kind, and each unit's kind; kinds are found by hash and decided by bytes."""
    _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
    sizes, to = w.ends - w.starts, first[which]
    right = sizes == sizes[to]
    right[right] = equal_spans(w.data, w.starts[right], w.starts[to[right]], sizes[right])
    if not right.all():  # units of one hash that differ are kinds of their own
        raw, kinds = w.data.tobytes(), {}
        for i in np.flatnonzero(~right).tolist():
            which[i] = kinds.setdefault(raw[w.starts[i] : w.ends[i]], len(first) + len(kinds))
        _, first = np.unique(which, return_index=True)
    return first, which


class WordTokens:
    """Ids of texts from a tokenizer: each distinct unit is tokenised once.

    The tokenizer must fold case, must not join across white space, and must part marks from letters;
    one that doesn't on a sample sentence raises ValueError.
    """

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """The worker process's own."""
        if path not in _remembered:
            _remembered[path] = cls(path)
        return _remembered[path]

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        for whole, parts in SAMPLES:
            if one(whole) != [x for p in parts for x in one(p)]:
                raise ValueError(f"{path}: the tokenizer folds no case, joins across white space or doesn't part marks from letters")

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, units: list[bytes]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.known.update(zip(units, range(len(self.sizes), len(self.sizes) + len(units)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, np.fromiter((x for e in got for x in e), np.uint32, int(sizes.sum()))))

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for each document (and the end) where its ids begin."""
        first, which = _same_units(w)
        raw = w.data.tobytes()
        units = [raw[s:e] for s, e in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
        if len(self.known) > REMEMBERED:
            self.forget()
        if new := [u for u in units if u not in self.known]:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))[which]
        sizes = self.sizes[at]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.ids[flat], ends[w.first]


class Packer:
    """Windows of one partition; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, first_id: int) -> None:
        self.size, self.next_id = size, first_id
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]  # by level: windows, each a list of pieces

    def level_for(self, n: int) -> int:
        """The level whose choice leaves the least sum of squared counts; full windows aren't counted, ties go to the fuller."""
        change = np.full(self.size - n + 1, np.iinfo(np.int64).max)
        at = np.flatnonzero(self.count[1 : self.size - n + 1]) + 1
        change[at] = 2 * (self.count[at + n] - self.count[at]) + 2
        change[0] = 2 * self.count[n] + 1
        if self.count[self.size - n]:
            change[self.size - n] = 1 - 2 * self.count[self.size - n]
        return self.size - n - int(np.argmin(change[::-1]))

    def add(self, piece: tuple) -> list[tuple[int, list]]:
        """Windows that this piece fills."""
        doc, start, ids, total = piece
        done = []
        while len(ids) >= self.size:
            done.append(self.close([(doc, start, ids[: self.size], total)]))
            start, ids = start + self.size, ids[self.size :]
        if n := len(ids):
            level = self.level_for(n)
            window = self.open[level].pop() if level else []
            if level:
                self.count[level] -= 1
            window.append((doc, start, ids, total))
            if level + n == self.size:
                done.append(self.close(window))
            else:
                self.open[level + n].append(window)
                self.count[level + n] += 1
        return done

    def close(self, window: list) -> tuple[int, list]:
        self.next_id += 1
        return self.next_id - 1, window

    def drain(self) -> Iterator[tuple[int, list]]:
        """The rest: the emptiest windows are cut up into the gaps of the fullest."""
        rest = deque(w for level in self.open for w in level)
        loose: list[tuple] = []
        while rest or loose:
            window, loose = (rest.pop(), loose) if rest else (loose, [])
            gap = self.size - sum(len(p[2]) for p in window)
            while gap and (loose or rest):
                loose = loose or rest.popleft()
                doc, start, ids, total = loose.pop()
                if len(ids) > gap:
                    loose.append((doc, start + gap, ids[gap:], total))
                    ids = ids[:gap]
                window.append((doc, start, ids, total))
                gap -= len(ids)
            yield self.close(window)


def _rows(windows: list[tuple[int, list]]) -> pa.RecordBatch:
    out: list[list] = [[] for _ in _PIECE]
    for number, pieces in windows:
        offset = 0
        for doc, start, ids, total in pieces:
            for column, value in zip(out, (doc, start, len(ids), ids.tobytes(), total, number, offset), strict=True):
                column.append(value)
            offset += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECE, strict=True)], schema=_PIECE)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    docs has doc_id and text; tokenizer is the path, on every executor, of a tokenizers file that
    folds case, drops white space and parts marks from letters.  A document is its ids and end_id; a null or empty text is end_id alone.  Each id
    lies in one piece; a sequence's pieces follow each other from offset 0 up to ``size``.
    sequence_id has the partition in its upper bits.  Repeated rows are documents of their own, rows
    without doc_id are packed with a null doc_id, an empty table gives an empty one; other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of(tokenizer)
        packer = Packer(size, TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for b in blocks(batch.column("text")):
                flat, at = tokens.encode(units(b))
                done = []
                for i in range(b.n):
                    own = np.append(flat[at[i] : at[i + 1]], np.uint32(end_id))
                    done += packer.add((ids[b.first + i], 0, own, len(own)))
                if done:
                    yield _rows(done)
        for window in packer.drain():
            yield _rows([window])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)
