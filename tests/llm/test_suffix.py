import hashlib
import random

import numpy as np
import pytest

from cotejo.llm import suffix


def pieces_of(texts, places):
    sizes = np.array([len(t) for t in texts], np.int64)
    return suffix.Pieces(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes, np.array(places, np.int64))


def aligned(seed):
    """Texts around one gram, and where it begins in each."""
    rng = random.Random(seed)
    places = [rng.randrange(9) for _ in range(rng.randrange(1, 30))]
    letters = b"ab" if seed % 2 else b"a\x00\xff"
    return [bytes(rng.choices(letters, k=p)) + b"gg" + bytes(rng.choices(letters, k=rng.randrange(9))) for p in places], places


@pytest.mark.parametrize("chunk", [2, 7, 1 << 20])
@pytest.mark.parametrize("seed", range(6))
def test_construction_orders_suffixes(tmp_path, monkeypatch, seed, chunk):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    texts, places = aligned(seed)
    for column, order, prefixes in suffix.construct(pieces_of(texts, places), str(tmp_path)):
        found = [(texts[d][places[d] + column :], d) for d in order.tolist()]
        assert found == sorted((t[p + column :], d) for d, (t, p) in enumerate(zip(texts, places, strict=True)) if 0 <= p + column < len(t))
        for (a, _), (b, _), n in zip(found, found[1:], prefixes[1:].tolist(), strict=False):
            assert n == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert list(suffix.construct(pieces_of([], []), str(tmp_path))) == []


@pytest.mark.parametrize("seed", range(6))
def test_repeated_windows(seed):
    texts, places = aligned(seed)
    owners = np.array([i * 7 % 5 for i in range(len(texts))])
    masks = suffix.repeated_windows(pieces_of(texts, places), owners, 6)
    for t, p, o, mask in zip(texts, places, owners, masks.tolist(), strict=True):
        for i in range(min(p, len(t) - 6) + 1):
            expected = any(q < o and 0 <= i - p + r and u[i - p + r :][:6] == t[i : i + 6] for u, r, q in zip(texts, places, owners, strict=True))
            assert bool(mask >> i & 1) == expected


def test_documents(spark, monkeypatch):
    rng = random.Random(3)
    shared = "".join(rng.choices("abcdef ", k=70))
    texts = {i: "".join(rng.choices("abcdef é", k=rng.randrange(200))) for i in range(30)}
    for i in (3, 9, 12):
        texts[i] = texts[i][:40] + shared + texts[i][40:]
    texts |= {40: texts[9], 41: "", 42: "x" * 300, 43: "y" + "x" * 260}
    rows = [(i, t, "s") for i, t in texts.items()] + [(44, None, "s"), (None, texts[9], "s"), (9, texts[9], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(5)
    got = suffix.remove_repeats(df).collect()
    assert len(got) == len(rows)
    data = {i: (t or "").encode() for i, t, _ in rows if i is not None}
    for r in got:
        own = (r.text or "").encode()
        gone = np.zeros(len(own), bool)
        if r.doc_id is not None:
            for i in range(len(own) - 49):
                if any(d < r.doc_id and own[i : i + 50] in t for d, t in data.items()):
                    gone[i : i + 50] = True
        assert (r.n_bytes, r.n_removed) == (len(own), gone.sum())
        assert r.kept == bytes(np.frombuffer(own, np.uint8)[~gone])
        assert r.n_spans == (np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()
    assert suffix.remove_repeats(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_windows_with_repeated_grams(spark):
    """Passages of a little over 50 bytes that hold runs and patterns, at any offset modulo 64, each with other bytes around it."""
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passages = [letters(a) + (unit * 40)[:run] + letters(50 + more - a - run) for unit in ("-", "0", " ", "= ", "0,", "ab.") for run in (21, 30, 40) for a in (0, 3, 8) for more in (0, 2) if a + run <= 50]
    texts = {}
    for p in passages:
        for _ in range(4):
            texts[len(texts)] = letters(rng.randrange(30, 130)) + p + letters(rng.randrange(30, 60))
    rows = list(texts.items())
    rng.shuffle(rows)
    got = {r.doc_id: r for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    first: dict[str, int] = {}
    for d, t in texts.items():
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    for d, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        assert gone.any() == (d % 4 > 0)
        assert got[d].kept == bytes(np.frombuffer(t.encode(), np.uint8)[~gone]), (d, t)


def test_one_gram_of_very_many_pieces(spark):
    """A passage of which each document has a part of its own length, in more pieces than a chunk of a construction has."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = "THE GRAM IS HERE ALWAYS" + letters(80)
    texts = {i: letters(40) + passage[: 45 + i % 58] + letters(30) for i in range(8_000)}
    first: dict[str, int] = {}
    expected = {}
    for d, t in texts.items():
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 49):
            if first.setdefault(t[a : a + 50], d) < d:
                gone[a : a + 50] = True
        expected[d] = int(gone.sum())
    rows = suffix.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).select("doc_id", "n_removed").collect()
    assert {r.doc_id: r.n_removed for r in rows} == expected and sum(n > 0 for n in expected.values()) > 7000


def test_an_own_column_named_part_stays(spark):
    df = spark.createDataFrame([(1, "x" * 60, "a"), (2, "x" * 60, "b")], "doc_id long, text string, Part string")
    assert sorted((r.doc_id, r.Part, r.n_removed) for r in suffix.remove_repeats(df).collect()) == [(1, "a", 0), (2, "b", 60)]


def test_runs_do_not_depend_on_the_block():
    text = b"x" * 90 + b"ab" * 40 + b"-" * 100
    found = []
    for before in (0, 13, 37, 63):
        b = suffix.Block(np.frombuffer(b"y" * before + text, np.uint8), np.array([0, before, before + len(text)]), 0)
        doc, start, n, key, place = suffix._runs(b, 50, 20)
        own = doc == 1
        found.append([x[own].tolist() for x in (start - before, n, key, place - before)])
    assert all(f == found[0] for f in found)
