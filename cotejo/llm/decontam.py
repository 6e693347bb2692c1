"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive k-grams of words the one with the smallest hash is kept
(the rightmost on ties).  A span of ``window`` words shared by a document and an item has the same
k-grams in both, so the same one is kept in both: joining the fingerprints finds every such span.
Each hit is extended to the windows of the document around it, and one counts where its words are those
of a window of an item that was hit; so a gram that both repeat costs its places, not their product.
Items shorter than a window are fingerprinted whole, and documents by their runs of those lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.kernels import ALNUM_BYTES, LOWER, Words, blocks, extended, free_name, sliding_min, words

#: Items are broadcast up to so many bytes of texts (which bounds their fingerprints too); more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
PRINT = "id long, k int, print long"


def winnow(w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the kept k-grams of whole windows."""
    starts = np.flatnonzero(w.windows(window))
    grams = np.flatnonzero(w.windows(k))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    h = np.zeros(len(w.starts), np.uint64)
    h[grams] = w.window_hash(grams, k)
    n = window - k + 1
    least = sliding_min(h, n)[starts]
    at = np.full(len(starts), -1)
    for step in range(n - 1, -1, -1):
        new = (at < 0) & (h[starts + step] == least)
        at[new] = starts[new] + step
    at = np.unique(at)
    return at, h[at]


def prints_of(w: Words, window: int, k: int, whole: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, word positions, hashes) of the winnowed k-grams and of every run of the lengths in whole."""
    for size in sorted({k, *whole}):
        # a length that is both k and whole keeps every run, which holds the winnowed ones
        if size in whole:
            at = np.flatnonzero(w.windows(size))
            yield size, at, w.window_hash(at, size)
        else:
            yield size, *winnow(w, window, k)


def fingerprints(df: DataFrame, window: int, k: int, whole: list[int]) -> DataFrame:
    """(id, k, print) of df's (id, text); whole: lengths of which every run is kept."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for b in blocks(batch.column("text")):
                w = words(b, ALNUM_BYTES, LOWER)
                for size, at, h in prints_of(w, window, k, whole):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[b.first + w.doc[at]]), pa.array(np.full(len(at), size, np.int32)), pa.array(h.view(np.int64))], names=["id", "k", "print"])

    return df.where(F.col("id").isNotNull()).select("id", "text").mapInArrow(make, PRINT)


def _item_words(items: DataFrame) -> DataFrame:
    """(item, ids, text, n): items of equal words as one, under the smallest id; those without words or id go."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for b in blocks(batch.column("text")):
                w = words(b, ALNUM_BYTES, LOWER, hashed=False)
                raw = w.data.tobytes()
                for i in range(b.n):
                    span = range(w.first[i], w.first[i + 1])
                    texts.append(b" ".join([raw[w.starts[j] : w.ends[j]] for j in span]))
                    counts.append(len(span))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int32())], names=["item_id", "text", "n"])

    folded = items.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL").mapInArrow(fold, "item_id long, text string, n int")
    return folded.where("n > 0").groupBy("text", "n").agg(F.min("item_id").alias("id"), F.collect_set("item_id").alias("ids"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Every column of docs, with n_words, n_hit (long), items (array of item ids that occur, sorted).

    docs has doc_id (long) and text, items item_id and text.  Words are runs of ASCII letters (folded
    to lower case), digits and non-ASCII characters.  A window is ``window`` consecutive words of an
    item, or a shorter item as a whole; a document word inside an occurrence of a window is hit.  Null
    and wordless texts have no words and no hit; items without words or id are in no document;
    repeated rows each get their result, and rows that share a doc_id are judged by their own texts; rows
    without doc_id are not searched (n_hit 0).  Columns of docs of the added names are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "items")
    columns, told = docs.columns, free_name(docs.columns, "hits")
    kinds = _item_words(items)
    whole = [r["n"] for r in kinds.where(F.col("n") < window).select("n").distinct().collect()]  # below window, so at most that many
    prints = fingerprints(kinds.where(F.col("n") >= window), window, k, [])
    for n in whole:
        prints = prints.unionByName(fingerprints(kinds.where(F.col("n") == n), window, k, [n]).where(F.col("k") == n))
    prints = prints.withColumnRenamed("id", "item").distinct()
    small = kinds.agg(F.coalesce(F.sum(F.octet_length("text") + 8 * F.size("ids")), F.lit(0))).first()[0] <= BROADCAST_BYTES
    own = fingerprints(docs.select(F.col("doc_id").alias("id"), "text"), window, k, whole)
    hits = own.join(F.broadcast(prints) if small else prints, ["k", "print"]).groupBy("id", "item").agg(F.collect_set(F.struct("k", "print")).alias("prints"))
    kinds = kinds.select(F.col("id").alias("item"), "ids", F.col("text").alias("item_text"))
    hits = hits.join(F.broadcast(kinds) if small else kinds, "item")
    hits = hits.groupBy(F.col("id").alias("doc_id")).agg(F.collect_list(F.struct("prints", "ids", "item_text")).alias(told))

    def occurrences(own: list[bytes], places: dict[int, np.ndarray], found: list[dict]) -> Iterator[tuple[int, int, set]]:
        """(word, length, item ids) of each window of an item that begins in the document near a hit."""
        known: dict[tuple, set] = {}
        for item in found:
            said = item["item_text"].encode().split(b" ")
            size = min(window, len(said))
            for j in range(len(said) - size + 1):
                known.setdefault(tuple(said[j : j + size]), set()).update(item["ids"])
        for size, at in places.items():
            long = size if size in whole else window
            begin = np.unique((at[:, None] - np.arange(long - size + 1)).ravel())
            for j in begin[(begin >= 0) & (begin + long <= len(own))].tolist():
                if ids := known.get(tuple(own[j : j + long])):
                    yield j, long, ids
            if size == k and size in whole:  # hits of winnowed grams too
                begin = np.unique((at[:, None] - np.arange(window - k + 1)).ravel())
                for j in begin[(begin >= 0) & (begin + window <= len(own))].tolist():
                    if ids := known.get(tuple(own[j : j + window])):
                        yield j, window, ids

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, hit, found = [], [], []
            told_of = batch.column(told)
            for b in blocks(batch.column("text")):
                some = [told_of[b.first + i].as_py() for i in range(b.n)]
                w = words(b, ALNUM_BYTES, LOWER, hashed=any(some))
                prints = list(prints_of(w, window, k, whole)) if w.hash is not None else []
                raw = w.data.tobytes()
                for i, items_hit in enumerate(some):
                    low, high = int(w.first[i]), int(w.first[i + 1])
                    n, ids, gone = high - low, set(), bytearray(high - low)
                    if items_hit:
                        own = [raw[s:e] for s, e in zip(w.starts[low:high].tolist(), w.ends[low:high].tolist(), strict=True)]
                        places = {}
                        for size, at, h in prints:
                            part = slice(*np.searchsorted(at, (low, high)))
                            wanted = np.array([p["print"] for x in items_hit for p in x["prints"] if p["k"] == size], np.int64)
                            places[size] = at[part][np.isin(h[part].view(np.int64), wanted)] - low
                        for at, size, which in occurrences(own, places, items_hit):
                            gone[at : at + size] = b"\x01" * size
                            ids |= which
                    total.append(n)
                    hit.append(sum(gone))
                    found.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=[*columns, "n_words", "n_hit", "items"]
            )

    return docs.join(hits.hint("shuffle_hash"), "doc_id", "left").mapInArrow(extend, extended(docs.schema, "n_words long", "n_hit long", "items array<long>"))
