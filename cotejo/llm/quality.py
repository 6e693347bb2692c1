"""Quality rules judged by host.

Each document is measured and fails or passes a few rules.  Failures are summed by host, and each
host's failure rate is shrunk towards the corpus by a beta prior whose two parameters are fitted to
the hosts' rates by moments (so a host of few documents keeps close to the corpus).  A host whose
shrunk rate passes ``max_rate`` is rejected with all its documents; one below ``trust_rate`` is
trusted, and between the two each document stands by its own rules.  The verdicts are joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm.kernels import U64, blocks, covered, equal_spans, extended, free_name, mix, span_hash, words
from cotejo.plans.saved import saved

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The symbols counted.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
RUN = 8
#: Verdicts are broadcast up to so many hosts; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def _repeats(keys: np.ndarray, doc: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether an equal key of the same document came before, and whether there is another at all.

    Found by hash; equal(i, j) decides whether what the keys stand for is the same.
    """
    own = mix(keys + mix(doc.astype(U64) + U64(1)))
    earlier, others = np.zeros(len(own), bool), np.zeros(len(own), bool)
    left = np.arange(len(own))
    while len(left):  # once, but for different things of one hash
        _, first, which = np.unique(own[left], return_index=True, return_inverse=True)
        to = left[first[which]]
        later = np.flatnonzero(to != left)
        right = (doc[left[later]] == doc[to[later]]) & equal(left[later], to[later])
        earlier[left[later[right]]] = True
        others[left[later[right]]] = others[to[later[right]]] = True
        left = left[later[~right]]
    return earlier, others


def measure(docs: DataFrame) -> DataFrame:
    """Every column of docs (it has text), with the columns MEASURES (long); a null text measures 0."""
    docs = docs.drop(*MEASURES)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[], [], [], [], []]
            for b in blocks(batch.column("text")):
                w, data, n = words(b), b.data, b.n
                per_doc = lambda at: np.bincount(w.doc[at], minlength=n)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                parts[0].append(np.diff(w.first))
                parts[1].append(np.bincount(w.doc, points[w.ends] - points[w.starts], n).astype(np.int64))
                symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
                parts[2].append(symbols[b.offsets[1:]] - symbols[b.offsets[:-1]])
                breaks = np.flatnonzero(data == 0x0A)
                starts = np.union1d(b.offsets[:-1], breaks + 1)
                starts = starts[starts < len(data)]
                ends = np.minimum.reduce([np.append(starts[1:], len(data)), *([np.append(breaks, len(data))[np.searchsorted(breaks, starts)]] if len(starts) else [])])
                filled = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
                starts, ends = starts[filled], ends[filled]
                doc = np.searchsorted(b.offsets, starts, "right") - 1
                size = ends - starts
                same_line = lambda i, j: (size[i] == size[j]) & equal_spans(data, starts[i], starts[j], np.where(size[i] == size[j], size[i], 0))
                earlier, _ = _repeats(span_hash(data, starts, ends), doc, same_line)
                parts[3].append(np.bincount(doc[earlier], minlength=n))
                n_bytes = w.ends - w.starts
                same_word = lambda i, j: (n_bytes[i] == n_bytes[j]) & equal_spans(data, w.starts[i], w.starts[j], np.where(n_bytes[i] == n_bytes[j], n_bytes[i], 0))
                at = np.flatnonzero(w.windows(RUN))
                _, twice = _repeats(w.window_hash(at, RUN), w.doc[at], lambda i, j: np.logical_and.reduce([same_word(at[i] + k, at[j] + k) for k in range(RUN)]))
                parts[4].append(per_doc(covered(at[twice], RUN, len(w.starts))))
            sums = [pa.array(np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64)) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + sums, names=[*columns, *MEASURES])

    return docs.mapInArrow(run, extended(docs.schema, *(f"{name} long" for name in MEASURES)))


def base_failed() -> F.Column:
    """Fewer than 20 words, or over 30 % of them in repeated runs."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def failed() -> F.Column:
    """Any rule: base_failed, words of under 2 or over 12 characters on average, over a symbol for 10 words, over a repeated line for 10 words."""
    return base_failed() | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")) | (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > F.col("n_words"))


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """(host, n, bad, rate): the failure rate shrunk by the beta prior fitted to all hosts by moments.

    With m and v the mean and variance of the hosts' raw rates, a + b = m (1 - m) / v - 1, kept within
    1 and 1000 (both when v is 0 or there is one host: 1000, and 1 when the rates spread more than a
    beta can), a = m (a + b).
    """
    hosts = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(failed().cast("long")).alias("bad"))
    raw = F.col("bad") / F.col("n")
    prior = hosts.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v"))
    strength = F.when(F.col("v") > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(1000.0)
    prior = prior.select(F.struct(F.col("m"), strength.alias("s")).alias("prior")).scalar()
    return hosts.withColumn("prior", prior).select("host", "n", "bad", ((F.col("bad") + F.col("prior.m") * F.col("prior.s")) / (F.col("n") + F.col("prior.s"))).alias("rate"))


def judge(docs: DataFrame, host: str = "source", max_rate: float = 0.5, trust_rate: float = 0.05) -> DataFrame:
    """Every column of docs, with MEASURES, base_failed, host_rate (double) and kept (boolean).

    docs has text and the column ``host``.  kept is false if base_failed; else true for a host whose
    shrunk rate is below trust_rate, false for one above max_rate, and otherwise whether the document
    passes every rule itself, as for a document without a host (host_rate null).  A null or empty text
    fails the base rules.  Columns of docs of the added names are replaced.
    """
    measured = measure(docs.drop("base_failed", "host_rate", "kept"))
    own = free_name(measured.columns, "_host")
    rates = saved(host_rates(measured.select(host, *MEASURES), host).select(F.col("host").alias(own), F.col("rate").alias("host_rate")))
    small = rates.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = measured.join(F.broadcast(rates) if small else rates, F.col(host) == F.col(own), "left").drop(own)
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & F.when(F.col("host_rate") > max_rate, False).when(F.col("host_rate") < trust_rate, True).otherwise(~failed())
    )
