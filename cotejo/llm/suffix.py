"""Suffix-array dedup of byte strings by column-wise multi-document construction.

The construction (``construct``) holds the Burrows-Wheeler transform and the common prefixes of a
collection of short documents.  In each round every document gives one symbol, from its end on.  The
symbols before the suffixes, read in the order of the suffixes, tell the next order: suffixes with one
symbol in front stay in their order, behind those of smaller symbols, and have one more in common than the
least common prefix between them.  Suffixes, common prefixes and transform are files that a round reads once in
order, a chunk at a time, and writes anew in one run for each symbol.

As many rounds as the longest text has bytes, each over all texts, can't run as Spark jobs.  So the
texts are first cut into pieces of at most ``2 * least - gram`` bytes such that equal windows of
``least`` bytes lie in pieces with one key, at the same distance from the key's gram: a window's key is
its smallest ``gram``-byte hash, the leftmost of equal ones, and a piece holds the consecutive windows that
one such gram is the key of.  The columns of a collection are aligned on the grams, so a round inserts
the symbol of one column, and a suffix is only ordered among those that begin in its column.

1. Documents send their keys to buckets, which tell the keys that several documents hold.
2. Around those keys, pieces are sent to the bucket of their key, one for each batch and text; equal
   pieces of later documents are known to repeat.  Each bucket constructs its pieces' transform and
   finds the windows that start in a document with a smaller id.
3. Documents hear of the windows and lose the bytes that those cover.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cotejo.llm.exchange import FIND, Answers, bucket_count, keyed_rows, low_bytes, narrow, part_count, part_of, parted, runs, shared_keys, widen, with_answers
from cotejo.llm.kernels import U64, Block, blocks, covered, equal_spans, extended, free_name, gram_hash, sliding_min, span_hash

#: What precedes a document's first byte in the transform; bytes are 1 to 256.
ENDED = 0
#: Suffixes that a round reads at once.
CHUNK = 1 << 20
WHOLE = (1 << 64) - 1


class Files:
    """A construction's sequential files: of each name the ones that a round reads and those that it writes.

    They are a task's scratch, like Spark's own spill files: no other task reads them, and a lost executor's
    task makes them anew.
    """

    KINDS = {"suffixes": np.int32, "prefixes": np.uint8, "symbols": np.uint16}

    def __init__(self, folder: str, n: int) -> None:
        self.pair = [{name: np.memmap(f"{folder}/{name}{i}", kind, "w+", shape=n) for name, kind in self.KINDS.items()} for i in range(2)]

    def turn(self) -> tuple[dict, dict]:
        """The files to read, which were written last, and those to write."""
        self.pair.reverse()
        return self.pair[1], self.pair[0]


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low:high] for each pair; all are non-empty."""
    span = (high - low).astype(np.int64)
    level = np.frexp(span.astype(np.float64))[1] - 1  # floor of the logarithm
    out = np.empty(len(low), values.dtype)
    table, step = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - step])
        if 2 * step <= len(values):
            table = np.minimum(table[:-step], table[step:])
        step *= 2
    return out


class Pieces:
    """Short documents in one buffer, each with the place where its gram begins: column 0."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> None:
        self.data, self.sizes, self.places = data, sizes, places
        self.origin = starts + places  # of column 0
        self.end = sizes - places  # the column after the last

    def symbols(self, which: np.ndarray, column: int) -> np.ndarray:
        out = np.full(len(which), ENDED, np.uint16)
        here = np.flatnonzero(column >= -self.places[which])
        out[here] = self.data[self.origin[which[here]] + column].astype(np.uint16) + 1
        return out


def construct(pieces: Pieces, folder: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, documents, prefixes) from the last column to the first: the documents with a symbol there in
    the order of their suffixes from there on, and what each suffix has in common with the one before.

    Equal suffixes are in the order of documents.  Prefixes are counted up to 255.
    """
    n = len(pieces.sizes)
    if not n:
        return
    files, size = Files(folder, n), 0
    entering = np.argsort(-pieces.end, kind="stable")
    entered = 0
    for column in range(int(pieces.end.max(initial=1)) - 1, -int(pieces.places.max(initial=0)) - 1, -1):
        # documents that end here enter with an empty suffix, which is before all others
        until = entered + int(np.searchsorted(-pieces.end[entering[entered:]], -column))
        new, entered = np.sort(entering[entered:until]), until
        was, now = files.turn()
        chunks = [(new, np.zeros(len(new), np.uint8), pieces.symbols(new, column))] if len(new) else []
        counts = np.bincount(chunks[0][2], minlength=257) if chunks else np.zeros(257, np.int64)
        for at in range(0, size, CHUNK):
            counts += np.bincount(was["symbols"][at : min(at + CHUNK, size)], minlength=257)
        counts[ENDED] = 0
        begin = np.cumsum(counts) - counts
        least, seen = np.full(257, 255, np.uint8), np.zeros(257, bool)  # least prefix since a symbol's last suffix
        reads = ((np.asarray(was["suffixes"][at : min(at + CHUNK, size)]), np.asarray(was["prefixes"][at : min(at + CHUNK, size)]), np.asarray(was["symbols"][at : min(at + CHUNK, size)])) for at in range(0, size, CHUNK))
        for suffixes, prefixes, symbols in (*chunks, *reads):
            order = np.argsort(symbols, kind="stable")
            order = order[np.searchsorted(symbols[order], 1) :]
            one = symbols[order]
            first = np.concatenate(([True], one[1:] != one[:-1])) if len(one) else np.zeros(0, bool)
            common = np.zeros(len(one), np.uint8)
            back = np.flatnonzero(~first)
            common[back] = np.minimum(_range_minima(prefixes, order[back - 1] + 1, order[back] + 1), 254) + 1
            lead = np.flatnonzero(first)
            lead = lead[seen[one[lead]]]
            common[lead] = np.minimum(np.minimum(least[one[lead]], np.minimum.accumulate(prefixes)[order[lead]]), 254) + 1
            cut = np.flatnonzero(first)
            told = one[cut]
            number = np.diff(np.append(cut, len(one)))
            to = np.arange(len(one)) - np.repeat(cut, number) + np.repeat(begin[told], number)
            now["suffixes"][to] = suffixes[order]
            now["prefixes"][to] = common
            now["symbols"][to] = pieces.symbols(suffixes[order], column - 1)
            begin[told] += number
            # from the last suffix of each symbol on
            np.minimum(least, prefixes.min(), out=least)
            after = np.append(np.minimum.accumulate(prefixes[::-1])[::-1], 255)
            least[told] = after[order[cut + number - 1] + 1]
            seen[told] = True
        size = int(counts.sum())
        yield column, now["suffixes"][:size], now["prefixes"][:size]


def repeated_windows(pieces: Pieces, owners: np.ndarray, least: int) -> np.ndarray:
    """For each piece, the bits of its windows of ``least`` bytes that a piece of a smaller owner has in the same columns."""
    masks = np.zeros(len(owners), U64)
    scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    with tempfile.TemporaryDirectory(dir=scratch if os.path.isdir(scratch) else None) as folder:
        for column, order, prefixes in construct(pieces, folder):
            if column > 0:
                continue
            joined = prefixes >= least  # with the suffix before
            some = joined.copy()
            some[:-1] |= joined[1:]
            at = np.flatnonzero(some)
            if not len(at):
                continue
            which = order[at].astype(np.int64)
            cut = np.flatnonzero(~joined[at])
            first = np.minimum.reduceat(owners[which], cut)
            later = which[owners[which] > np.repeat(first, np.diff(np.append(cut, len(at))))]
            masks[later] |= U64(1) << (pieces.places[later] + column).astype(U64)
    return masks


def _runs(b: Block, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose key is one gram: their document, first window, number of windows, key, and the gram's place.

    A window's gram is told by the window alone: the one of the least hash (32 bits), the leftmost of such.
    """
    n = len(b.data) - least + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(U64), none
    h = gram_hash(b.data, gram)
    low = sliding_min(h >> U64(32) << U64(32) | np.arange(len(h), dtype=U64), least - gram + 1)
    place = (low & U64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(n)
    doc = np.repeat(np.arange(b.n), np.diff(np.minimum(b.offsets, n)))
    start = np.flatnonzero(start + least <= b.offsets[doc + 1])
    if not len(start):
        return none, none, none, none.astype(U64), none
    doc, place = doc[start], place[start]
    cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
    return doc[cut], start[cut], np.diff(np.append(cut, len(start))), h[place[cut]], place[cut]


PIECES = "bucket int, n int, sizes binary, places binary, texts binary, hashes binary, docs binary, base long, known boolean"
_PIECES = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("sizes", pa.binary()), ("places", pa.binary()), ("texts", pa.binary()), ("hashes", pa.binary()), ("docs", pa.binary()), ("base", pa.int64()), ("known", pa.bool_())])
TOLD = "part int, n int, hashes binary, masks binary, docs binary, base long"
_TOLD = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("masks", pa.binary()), ("docs", pa.binary()), ("base", pa.int64())])


def _same_as_before(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces in the order of their hashes: whether each is equal to an earlier one, and the first such; bytes decide."""
    same = np.concatenate(([False], hashes[1:] == hashes[:-1])) if len(hashes) else np.zeros(0, bool)
    while True:
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(hashes))))
        at = np.flatnonzero(same)
        to = first[at]
        right = (sizes[at] == sizes[to]) & (places[at] == places[to])
        right[right] = equal_spans(data, starts[at[right]], starts[to[right]], sizes[at[right]])
        if right.all():
            return same, first
        same[at[~right]] = False


def _sent(keys: np.ndarray, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray, docs: np.ndarray, data: np.ndarray, n_buckets: int) -> pa.Table:
    """Rows of PIECES: of equal pieces the smallest document's goes to the bucket of its key, the others' are known to repeat.  A row's texts are packed together."""
    order = np.lexsort((docs, hashes))
    hashes, docs, keys, starts, sizes, places = hashes[order], docs[order], keys[order] & low_bytes(FIND), starts[order], sizes[order], places[order]
    same, first = _same_as_before(data, hashes, starts, sizes, places)
    later = docs > docs[first]
    again = np.concatenate(([False], same[1:] & (docs[1:] == docs[:-1]))) if len(hashes) else same
    bucket = (keys % U64(n_buckets)).astype(np.int64)
    group = np.where(later, bucket[:1] * 2 + 1 if len(bucket) else 1, bucket * 2)
    use = np.flatnonzero(~again)
    use = use[np.argsort(group[use], kind="stable")]
    rows: dict[str, list] = {name: [] for name in _PIECES.names}
    for i, j in runs(group[use]):
        at, known = use[i:j], bool(group[use[i]] & 1)
        base = int(docs[at].min())
        texts = None if known else pa.compress(_joined(data, starts[at], sizes[at]).tobytes(), codec="zstd", asbytes=True)
        values = (int(group[at[0]] >> 1), len(at), None if known else narrow(sizes[at].astype(U64)), None if known else narrow(places[at].astype(U64)), texts, narrow(hashes[at], 8), narrow((docs[at] - base).astype(U64)), base, known)
        for name, value in zip(rows, values, strict=True):
            rows[name].append(value)
    return pa.table(rows, schema=_PIECES)


def _joined(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after another."""
    out = np.empty(int(sizes.sum()), np.uint8)
    at = 0
    for i in range(0, len(sizes), 4096):  # an index is many times a byte
        n = sizes[i : i + 4096]
        more = int(n.sum())
        out[at : at + more] = data[np.arange(more) + np.repeat(starts[i : i + 4096] - (np.cumsum(n) - n), n)]
        at += more
    return out


def _alike(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray, least: int, gram: int) -> np.ndarray:
    """Whether each distinct piece could share a window with another.

    A window has at least half of its other bytes on one side of its gram, so two pieces that share
    one agree in the gram and so many bytes before or behind it.
    """
    half = (least - gram + 1) // 2
    out = np.zeros(len(sizes), bool)
    for some, begin in ((places >= half, -half), (sizes - places >= gram + half, 0)):
        which = np.flatnonzero(some)
        at = starts[which] + places[which] + begin
        _, own, count = np.unique(span_hash(data, at, at + gram + half), return_inverse=True, return_counts=True)
        out[which[count[own] > 1]] = True
    return out


def _resolve(least: int, gram: int, n_parts: int):
    def resolve(batches):
        sizes, places, texts, hashes, docs, done = [], [], [], [], [], []
        for batch in batches:
            for n, z, at, t, h, d, base, known in zip(*(batch.column(c).to_pylist() for c in ("n", "sizes", "places", "texts", "hashes", "docs", "base", "known")), strict=True):
                own = widen(d, n).astype(np.int64) + base
                if known:
                    done.append((widen(h, n), own, np.full(n, WHOLE, U64)))
                    continue
                sizes.append(widen(z, n).astype(np.int64))
                places.append(widen(at, n).astype(np.int64))
                hashes.append(widen(h, n))
                docs.append(own)
                texts.append(np.frombuffer(pa.decompress(t, decompressed_size=int(sizes[-1].sum()), codec="zstd", asbytes=True), np.uint8))
        if sizes:
            sizes, places, hashes, docs, data = (np.concatenate(x) for x in (sizes, places, hashes, docs, texts))
            texts.clear()
            order = np.lexsort((docs, hashes))
            starts = (np.cumsum(sizes) - sizes)[order]
            sizes, places, hashes, docs = sizes[order], places[order], hashes[order], docs[order]
            same, first = _same_as_before(data, hashes, starts, sizes, places)
            later = docs > docs[first]
            done.append((hashes[later], docs[later], np.full(int(later.sum()), WHOLE, U64)))
            # of distinct pieces, those that agree with another around their gram
            at = np.flatnonzero(~same)
            at = at[_alike(data, starts[at], sizes[at], places[at], least, gram)]
            data = _joined(data, starts[at], sizes[at])
            masks = repeated_windows(Pieces(data, np.cumsum(sizes[at]) - sizes[at], sizes[at], places[at]), docs[at], least)
            some = masks > 0
            # equal pieces of later documents are wholly told already, those of the same document alike
            done.append((hashes[at][some], docs[at][some], masks[some]))
        if not done:
            return
        hashes, docs, masks = (np.concatenate(x) for x in zip(*done, strict=True))
        part = part_of(docs, n_parts)
        order = np.argsort(part, kind="stable")
        rows: dict[str, list] = {name: [] for name in _TOLD.names}
        for i, j in runs(part[order]):
            at = order[i:j]
            base = int(docs[at].min())
            for name, value in zip(rows, (int(part[at[0]]), len(at), narrow(hashes[at], 8), narrow(masks[at], 8), narrow((docs[at] - base).astype(U64)), base), strict=True):
                rows[name].append(value)
        yield pa.RecordBatch.from_pydict(rows, schema=_TOLD)

    return resolve


def remove_repeats(docs: DataFrame, least: int = 50, gram: int = 20) -> DataFrame:
    """Every column of docs, with n_bytes, n_removed, n_spans (long) and kept (binary, the bytes left).

    docs has doc_id (long) and text.  Removed is each byte covered by a string of ``least`` bytes that
    also starts in a document with a smaller doc_id; n_spans counts maximal removed runs.  A null text
    is empty.  Rows that share a doc_id are one document's and don't remove each other's bytes; rows
    without doc_id keep all; an empty table gives an empty one.  Columns of docs of the added names
    are replaced.
    """
    if not gram <= least < gram + 64:
        raise ValueError("least must be at least gram and below gram + 64")
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    n_buckets, columns, part = bucket_count(docs), docs.columns, free_name(docs.columns, "part")
    docs = parted(docs, part, n_buckets)

    def keys_of(batch: pa.RecordBatch):
        ids = batch.column("doc_id").to_numpy()
        keys, owners = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for b in blocks(batch.column("text")):
            doc, _, _, key, _ = _runs(b, least, gram)
            keys.append(key)
            owners.append(ids[b.first + doc])
        return np.concatenate(keys), None, np.concatenate(owners)

    shared = shared_keys(keyed_rows(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), keys_of, False, n_buckets), False, n_buckets)

    def send(rows: pa.Table, found: Answers) -> pa.Table:
        ids = rows.column("doc_id").to_pylist()
        parts = []
        for b in blocks(rows.column("text")):
            own = [found.of(ids[b.first + i]) for i in range(b.n)]
            if not any(map(len, own)):
                continue
            doc, start, n, key, place = _runs(b, least, gram)
            cut = np.searchsorted(doc, np.arange(b.n + 1))
            at = np.concatenate([cut[i] + np.flatnonzero(found.has(own[i], key[cut[i] : cut[i + 1]])) for i in range(b.n) if len(own[i])])
            end = start[at] + n[at] - 1 + least
            owner = np.array([ids[b.first + d] for d in doc[at].tolist()], np.int64)
            parts.append((key[at], span_hash(b.data, start[at], end), start[at], n[at] - 1 + least, owner, b.data, place[at] - start[at]))
        if not parts:
            return pa.table({name: [] for name in _PIECES.names}, schema=_PIECES)
        shift = np.cumsum([0] + [len(p[5]) for p in parts])
        keys, hashes, sizes, owners, data, places = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3, 4, 5, 6))
        starts = np.concatenate([p[2] + s for p, s in zip(parts, shift, strict=False)])
        return _sent(keys, hashes, starts, sizes, places, owners, data, n_buckets)

    pieces = with_answers(docs, part, shared, False, send, PIECES)
    told = pieces.repartitionById(n_buckets, "bucket").mapInArrow(_resolve(least, gram, part_count(n_buckets)), TOLD)

    def remove(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        got = [(widen(d, n).astype(np.int64) + base, widen(h, n), widen(m, n)) for n, h, m, d, base in zip(*(found.column(c).to_pylist() for c in ("n", "hashes", "masks", "docs", "base")), strict=True)]
        owners, hashes, masks = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))
        order = np.lexsort((hashes, owners))
        owners, hashes, masks = owners[order], hashes[order], masks[order]
        ids = rows.column("doc_id").to_pylist()
        total, removed, spans, kept = [], [], [], []
        for b in blocks(rows.column("text")):
            span = [np.searchsorted(owners, (d, d + 1)) if d is not None else (0, 0) for d in ids[b.first : b.first + b.n]]
            some = any(j > i for i, j in span)
            if some:
                doc, start, n, _, _ = _runs(b, least, gram)
                told_of = np.flatnonzero(np.array([j > i for i, j in span])[doc])
                doc, start, n = doc[told_of], start[told_of], n[told_of]
                own = span_hash(b.data, start, start + n - 1 + least)
                cut = np.searchsorted(doc, np.arange(b.n + 1))
            raw = b.data.tobytes()
            for i, (low, high) in enumerate(span):
                begin, end = int(b.offsets[i]), int(b.offsets[i + 1])
                total.append(end - begin)
                if low == high:
                    removed.append(0)
                    spans.append(0)
                    kept.append(raw[begin:end])
                    continue
                mine = slice(cut[i], cut[i + 1])
                at = np.minimum(low + np.searchsorted(hashes[low:high], own[mine]), high - 1)
                mask = np.where(hashes[at] == own[mine], masks[at], U64(0))
                hit = np.flatnonzero(mask)
                offset = np.arange(least - gram + 1)
                bits = (mask[hit, None] >> offset.astype(U64) & U64(1)).astype(bool) & (offset < n[mine][hit, None])
                gone = covered((start[mine][hit, None] + offset)[bits] - begin, least, end - begin)
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(b.data[begin:end][~gone].tobytes())
        more = [pa.array(x, pa.int64()) for x in (total, removed, spans)] + [pa.array(kept, pa.binary())]
        return pa.Table.from_arrays([rows.column(c) for c in columns] + more, names=[*columns, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = extended(docs.drop(part).schema, "n_bytes long", "n_removed long", "n_spans long", "kept binary")
    return docs.groupBy(part).cogroup(told.groupBy("part")).applyInArrow(remove, schema)
