"""Substring dedup by difference-cover anchors.

A set of residues is a difference cover modulo a period when every distance between two numbers is
a difference of two of its members.  Anchors are hashes of short word runs that start at cover
positions.  For two equal windows of ``window`` words, wherever they start, some shift below the
period puts both on cover positions, and the run there lies inside both windows: so every window
that repeats holds an anchor that two documents share.

1. Each document sends its anchors to their buckets; each bucket tells which ones are shared.
2. Around shared anchors the match is extended to whole windows, whose 96-bit hashes are sent on;
   a document hears of its windows that start in a document with a smaller id.
3. The words those windows cover are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cotejo.llm.exchange import REQUEST, Answers, bucket_count, keyed_rows, parted, requests, shared_keys, with_answers
from cotejo.llm.kernels import U64, blocks, covered, extended, free_name, words

#: Perfect difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18)}


def _anchors(w, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the anchors and their hashes."""
    run = window - period + 1
    at = np.flatnonzero(w.windows(run))
    at = at[np.isin((at - w.first[w.doc[at]]) % period, COVERS[period])]
    return at, w.window_hash(at, run)


def remove_repeats(docs: DataFrame, window: int = 13, period: int = 7) -> DataFrame:
    """Every column of docs, with n_words, n_removed (long) and kept (the words left, joined by a space).

    docs has doc_id (long) and text.  Removed is each word covered by a run of ``window`` words that
    also starts in a document with a smaller doc_id.  A null text has no words; a text with none keeps
    ''.  Rows that share a doc_id are one document's and don't remove each other's words; rows without
    doc_id keep all.  An empty table gives an empty one.  Columns of docs of the names n_words,
    n_removed and kept are replaced.
    """
    if period not in COVERS or period > window:
        raise ValueError(f"period must be one of {sorted(COVERS)} and at most window")
    docs = docs.drop("n_words", "n_removed", "kept")
    n_buckets, columns, part = bucket_count(docs), docs.columns, free_name(docs.columns, "part")
    docs = parted(docs, part, n_buckets)

    def anchor_keys(batch: pa.RecordBatch):
        ids = batch.column("doc_id").to_numpy()
        keys, owners = [], []
        for b in blocks(batch.column("text")):
            w = words(b)
            at, h = _anchors(w, window, period)
            keys.append(h)
            owners.append(ids[b.first + w.doc[at]])
        return _cat(keys, U64), None, _cat(owners, np.int64)

    anchors = shared_keys(keyed_rows(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), anchor_keys, False, n_buckets), False, n_buckets)

    def extend(rows: pa.Table, found: Answers) -> pa.Table:
        ids = rows.column("doc_id").to_pylist()
        keys, more, owners = [], [], []
        for b in blocks(rows.column("text")):
            own = [found.of(ids[b.first + i]) for i in range(b.n)]
            if not any(map(len, own)):
                continue
            w = words(b)
            at, h = _anchors(w, window, period)
            cut = np.searchsorted(at, w.first)
            starts = []
            for i in range(b.n):
                if len(own[i]):
                    hit = at[cut[i] : cut[i + 1]][found.has(own[i], h[cut[i] : cut[i + 1]])]
                    s = np.unique((hit[:, None] - np.arange(period)).ravel())
                    starts.append(s[(s >= w.first[i]) & (s <= w.first[i + 1] - window)])
            at = _cat(starts, np.int64)
            keys.append(w.window_hash(at, window))
            more.append(w.window_hash(at, window, 1))
            owners.append(np.array([ids[b.first + d] for d in w.doc[at].tolist()], np.int64))
        return pa.Table.from_batches([requests(_cat(keys, U64), _cat(more, U64), _cat(owners, np.int64), n_buckets, True)])

    windows = shared_keys(with_answers(docs, part, anchors, False, extend, REQUEST), True, n_buckets)

    def remove(rows: pa.Table, found: Answers) -> pa.Table:
        ids = rows.column("doc_id").to_pylist()
        total, removed, kept = [], [], []
        for b in blocks(rows.column("text")):
            told = [found.of(ids[b.first + i]) for i in range(b.n)]
            w = words(b, hashed=any(map(len, told)))
            raw = b.data.tobytes()
            hashes = w.window_hash(np.arange(max(0, len(w.starts) - window + 1)), window) if w.hash is not None else None
            for i, own in enumerate(told):
                low, high = int(w.first[i]), int(w.first[i + 1])
                n, gone = high - low, None
                if len(own) and n >= window:
                    gone = covered(np.flatnonzero(found.has(own, hashes[low : high - window + 1])), window, n)
                left = np.arange(low, high) if gone is None else low + np.flatnonzero(~gone)
                total.append(n)
                removed.append(n - len(left))
                kept.append(b" ".join([raw[s:e] for s, e in zip(w.starts[left].tolist(), w.ends[left].tolist(), strict=True)]))
        out = [rows.column(c) for c in columns] + [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays(out, names=[*columns, "n_words", "n_removed", "kept"])

    schema = extended(docs.drop(part).schema, "n_words long", "n_removed long", "kept string")
    return with_answers(docs, part, windows, True, remove, schema)


def _cat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)
