"""Filter audit, exact dedup and whitening against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.llm import audit, whitening
from cotejo.llm.exact import deduplicate, exact_copies

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "la de THE été no # a|b".split() for b in ("", "x", "Ñ", "1", ".")]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = [make(rng.randrange(0, 120)) for _ in range(12)] + ["", None, "x " * 60, " ".join(f"w{i}" for i in range(70)), " ".join(f"W{i}" for i in range(70)), "é" * 5000]
    out = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""])) for i in range(300)]
    out += [(1000 + i, "hot", "a") for i in range(400)]
    return out + [(5, out[5][1], "b"), (5, "other text", "b"), (None, "hot", "a"), (None, "nobody's", None), (None, "nobody's", None)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(rows)], "doc_id long, text string, source string, place int, kept string").repartition(7).cache()


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("digest", [lambda t: hashlib.sha256(t).digest(), lambda t: bytes([len(t) % 2])])
def test_exact_copies(spark, table, rows, largest, digest):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = exact_copies(table, largest, salt_rows=3, digest=digest).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    groups = {}
    for doc, text, _ in rows:
        groups.setdefault(text or "", []).append(doc)
    kept = Counter()
    for r in got:
        doc, text, source = rows[r.place]
        group = groups[text or ""]
        known = [d for d in group if d is not None]
        assert r.keep_id == ((max if largest else min)(known) if known else None)
        assert (r.doc_id, r.source, r.group_size) == (doc, source, len(group))
        if r.kept:
            assert doc == r.keep_id
            kept[text or ""] += 1
    assert kept == Counter(groups.keys())


def test_exact_texts(spark, table, rows):
    got = deduplicate(table, normalise=F.lower("text")).collect()
    assert sorted(r.text for r in got) == sorted({(t or "").lower() for _, t, _ in rows})
    assert got[0].__fields__ == table.columns
    one = exact_copies(spark.createDataFrame([(1, "É", 9)], "doc_id long, text string, _row int")).first()
    assert one.text_sha256 == hashlib.sha256("É".encode()).hexdigest() and one.kept and one._row == 9
    assert exact_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    parts = {}
    for doc, text, source in rows:
        t = text or ""
        w = re.findall(SPACE, t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": doc is not None and doc > first[t]}
        parts.setdefault(source or "", []).append(({f for f in fails if fails[f]}, doc in good, doc in toxic))
    out = {}
    for part, own in parts.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[0]]
                redundant = sum(f in r[0] for r in gone)
                left, gone = [r for r in left if f not in r[0]], gone + removed
                total[f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(r[0] == {f} for r in own), sum(r[1] for r in removed), sum(r[2] for r in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_audit(spark, table, rows):
    rng = random.Random(3)
    labels = [(i, rng.randrange(2), rng.choice([0, 1, None])) for i in range(0, 1400, 2)] + [(4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, labels)
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.audit(table, told).collect()}
    assert got == want
    assert len(got) == 600 * len({p for p, _, _ in want})
    assert audit.audit(table.limit(0), told).collect() == []
    alone = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.audit(table, told.limit(0), F.lit("x")).collect()}
    assert alone == brute_audit([(d, t, "x") for d, t, _ in rows], [])


def test_survivors():
    rng = np.random.default_rng(2)
    failed, part = rng.integers(0, 32, 1000), rng.integers(0, 9, 1000)
    good = rng.random(1000) < 0.5
    codes, counts = audit.survivors(failed, [good], part, 5)
    for code, own in zip(codes, counts, strict=True):
        for s in range(32):
            left = (part == code) & (failed & s == 0)
            assert own[s].tolist() == [left.sum(), (left & good).sum()]
    assert audit.survivors(failed[:0], [good[:0]], part[:0], 5)[1].shape == (0, 32, 2)


def test_jacobi():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 8, 33):
        x = rng.normal(size=(3 * n + 1, n)) * np.logspace(0, -6, n)
        a = x.T @ x
        values, vectors = whitening.jacobi(a)
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13)
        assert np.allclose(vectors * values @ vectors.T, a, atol=1e-12 * a.max())
        assert (np.diff(values) <= 0).all()
        assert np.allclose(values, np.linalg.svd(x)[1] ** 2, rtol=1e-9)  # small ones too
    values, vectors = whitening.jacobi(np.zeros((4, 4)))
    assert not values.any() and np.array_equal(vectors, np.eye(4))


def test_whitening(spark):
    rng = np.random.default_rng(9)
    made = rng.normal(size=(500, 12)) @ rng.normal(size=(12, 12)) * 0.3 + 2
    rows = [(i, [float(c) for c in v], "clash") for i, v in enumerate(made)]
    bad = [(900, None), (901, []), (902, [1.0] * 11), (903, [None] + [1.0] * 11), (904, [float("nan")] + [1.0] * 11), (905, [float("inf")] + [0.0] * 11), (906, [1e300] * 12)]
    rows += [(i, v, "clash") for i, v in bad] + [(None, rows[3][1], None), (3, rows[3][1], None)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(5)).collect()
    kept = [(i, v) for i, v, _ in rows if i is None or i < 900]
    x = np.array([np.floor(1024 * np.array(v)).astype(np.int64) + 100_000 for _, v in kept])
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = centred @ vectors[:, :8] / np.sqrt(values[:8])
    assert len(got) == 8 * n
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for k, (i, _) in enumerate(kept):
        for c in range(8):
            for r in by[i, c + 1]:
                signs.setdefault(c, np.sign(r.whitened * want[k, c]))
                assert abs(r.whitened - signs[c] * want[k, c]) < 1e-9
                assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], sums, strict=True))
                assert abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    assert sum(map(len, by.values())) == 8 * n and len(by[None, 1]) == 1 and len(by[3, 1]) == 2


def test_whitening_corners(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []  # no direction
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], kind)).collect()
    assert [(r.component, abs(r.whitened), r.explained, r.deviation) for r in two] == [(1, 1.0, 1.0, 1024**2)] * 2
    far = [(i, [float(i) * 2.0**31, 1.0]) for i in range(3)]
    got = whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in got] == [None, 0, None] and max(abs(abs(r.whitened) - (0 if r.vec_id == 1 else 1.5**0.5)) for r in got) < 1e-12
