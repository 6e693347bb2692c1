"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import io
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cotejo.llm import chat, exchange, html, licenses, packing, warc
from cotejo.llm.decontam import contamination
from cotejo.llm.html import extract, main_text
from cotejo.llm.neardup import components, near_duplicates
from cotejo.llm.quality import host_rates, judge, measure
from cotejo.llm.substring import remove_repeats

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "La de the été no".split() for b in ("", "x", "Ñ", "1", ".")]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    out = {i: make(rng.randrange(0, 90)) for i in range(40)}
    passage = make(25)
    for i in (4, 11, 30):
        out[i] += "\n" + passage + "\n" + make(5)
    out[50], out[51], out[52] = out[4], out[4].upper(), out[4] + " tail"
    out |= {60: "", 61: None, 62: "word", 63: " \t\n", 64: "spam " * 3000, 65: make(4000), 66: "a\x1cb c　d"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, f"h{i % 3}" if i % 7 else None, "clash") for i, t in texts.items()] + [(4, texts[4], "h1", "clash"), (None, texts[4], "h1", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string").repartition(6).cache()


def test_substring(docs, texts):
    words = {i: re.findall(SPACE, t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for a in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][a : a + 13]), i)
    rows = remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        own = re.findall(SPACE, r.text or "")
        gone = [False] * len(own)
        for a in range(len(own) - 12):
            if r.doc_id is not None and first[tuple(own[a : a + 13])] < r.doc_id:
                gone[a : a + 13] = [True] * 13
        assert (r.n_words, r.n_removed) == (len(own), sum(gone))
        assert r.kept == " ".join(w for w, g in zip(own, gone, strict=True) if not g)
    assert remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs, period=5)


def test_decontamination(spark, docs, texts):
    items = {1: " ".join(re.findall(SPACE, texts[4])[-20:]), 2: "the de", 3: "absent words " * 8, 10: "THE... de!", 20: "", 21: None, 22: texts[65][100:300]}
    table = spark.createDataFrame([(i, t, 0) for i, t in items.items()] + [(None, "the de", 0)], "item_id long, text string, doc_id int")
    words = {i: re.findall(ALNUM, lower(t)) for i, t in items.items()}
    for r in contamination(docs, table).collect():
        own = re.findall(ALNUM, lower(r.text))
        gone, found = [False] * len(own), set()
        for i, w in words.items():
            k = min(10, len(w))
            windows = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if k else set()
            for a in range(len(own) - k + 1):
                if k and r.doc_id is not None and tuple(own[a : a + k]) in windows:
                    gone[a : a + k] = [True] * k
                    found.add(i)
        assert (r.n_words, r.n_hit, r["items"]) == (len(own), sum(gone), sorted(found)), r.doc_id
    none = contamination(docs, table.limit(0))
    assert none.agg(F.sum("n_hit")).first()[0] == 0


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


#: Texts that collide under any polynomial modulo 2**64.
ODD = (thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a"))


def test_texts_made_to_collide(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{ODD[0]} {rest}"), (2, f"{ODD[1]} {rest}"), (3, f"{ODD[0]} {rest}"), (4, f"{ODD[0]}\n{ODD[1]}\n{ODD[0]}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).coalesce(1)
    assert {r.doc_id: r.n_removed for r in remove_repeats(frame).collect()} == {1: 0, 2: 0, 3: 13, 4: 0}
    assert {r.doc_id: r.n_dup_lines for r in measure(frame).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert {r.doc_id: r.class_id for r in near_duplicates(frame, size=2).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    packed = packing.pack(frame, path).collect()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], np.uint32)
        assert b"".join(r.ids for r in sorted((r for r in packed if r.doc_id == i), key=lambda r: r.start)) == ids.tobytes()


def test_bytes_decide_where_hashes_collide(spark, docs, texts, monkeypatch):
    """With a hash of two bits the answers stay."""
    import numpy as np

    from cotejo.llm import kernels, quality

    weak = lambda data, starts, ends: np.asarray((ends - starts) & 3, np.uint64)
    block = next(kernels.blocks(pa.array([t for t in texts.values()])))
    right = packing._same_units(packing.units(block))
    monkeypatch.setattr(packing, "span_hash", weak)
    first, which = packing._same_units(packing.units(block))
    w = packing.units(block)
    raw = w.data.tobytes()
    own = [raw[s:e] for s, e in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
    assert len(first) == len(right[0]) == len(set(own)) and all(own[first[k]] == own[i] for i, k in enumerate(which.tolist()))
    keys, doc = np.zeros(6, np.uint64), np.array([0, 0, 0, 1, 1, 1])
    said = np.array([5, 6, 5, 6, 6, 7])
    earlier, others = quality._repeats(keys, doc, lambda i, j: said[i] == said[j])
    assert earlier.tolist() == [False, False, True, False, True, False] and others.tolist() == [True, False, True, True, True, False]


def test_own_columns_stay(spark):
    frame = spark.createDataFrame([(1, "a b", "s", 1, 2, 3, 4)], "doc_id long, text string, source string, part int, hits int, _host int, _salt int")
    for out in (remove_repeats(frame), judge(frame), contamination(frame, spark.createDataFrame([(1, "a b", 9)], "item_id long, text string, hits int"))):
        r = out.first()
        assert (r.part, r.hits, r._host, r._salt) == (1, 2, 3, 4)


def sets_of(texts, size):
    out = {}
    for i, t in texts.items():
        w = re.findall(SPACE, lower(t))
        out[i] = {tuple(w[a : a + size]) for a in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    return out


def test_near_duplicates(spark, texts):
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    more = dict(texts)
    for i in range(200, 260):
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(9999)}"
        more[i] = " ".join(own)
    frame = spark.createDataFrame([(i, t, "x") for i, t in more.items()] + [(4, more[4], "x"), (None, "lost", "x")], "doc_id long, text string, component_id string").repartition(5)
    sets = sets_of(more, 2)
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if c == high else c for i, c in label.items()}
    got = near_duplicates(frame, size=2).collect()
    assert len(got) == len(more) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), label[r.doc_id])
    assert near_duplicates(frame.limit(0), size=2).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 50), (60, 61), (61, 60), (5, 5)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3, 50)} == {1} and {got[i] for i in (7, 8, 9)} == {7} and got[61] == 60
    assert {got[i] for i in range(100, 131)} == {100}


def test_components_in_rounds(spark):
    """Contracted until nothing is left, however the links are dealt: a chain in order, a hub with a third of all links, and chance."""
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(1000, 4000)]
    hub = [(20_000, 20_001 + i) for i in range(3000)]
    chance = rng.integers(40_000, 43_000, (2000, 2)).tolist()
    links = [*chain, *hub, *chance, (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    expected = {x: find(x) for a, b in links if a != b for x in (a, b)}
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in links], "a long, b long").repartition(16)
    for most in (0, 500, 1 << 18):
        got = [(r.node, r.component) for r in components(frame, most).collect()]
        assert len(got) == len(expected) and dict(got) == expected
    assert components(frame.limit(0), 0).count() == 0


def test_quality(docs):
    for r in measure(docs).collect():
        t = r.text or ""
        w = re.findall(SPACE, t)
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = set()
        for i, x in enumerate(windows):
            if windows.count(x) > 1 if len(w) < 200 else x == windows[0]:
                twice.update(range(i, i + 8))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        if len(w) < 200 or set(w) == {"spam"}:
            assert r.n_repeat_words == len(twice)
    judged = judge(docs).collect()
    assert len(judged) == docs.count() and not any(r.kept for r in judged if r.base_failed)
    rates = host_rates(measure(docs), "source").collect()
    low, high = min(r.bad / r.n for r in rates), max(r.bad / r.n for r in rates)
    assert all(low - 1e-9 <= r.rate <= high + 1e-9 for r in rates)
    assert judge(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<div class="ad">Buy &lt;now&gt;<article class="post"><h1>Head  &amp; title</h1><p>One <b>two<br>three</b> &#233;t&eacute;<!-- <p>no</p> --><p>1 < 2 and a > b</p><form>Name <input></form>
<aside>Side</aside><div id="comments"><article>Reader</article></div><p title="a > b">Last</article><footer>Foot</footer>"""


class Article(HTMLParser):
    """The blocks of the article of a well-formed page, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.text = 0, [], ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        if tag in ("article", "h1", "p"):
            self.end()
        self.text += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.end()
        self.depth -= tag == "article"

    def handle_data(self, data):
        self.text += data if self.depth else ""

    def end(self):
        if self.depth and self.text.split():
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""


def test_html_query(spark):
    from cotejo.llm.queries import op5_html_extraction

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = op5_html_extraction(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages) > 0
    for r in got:
        parser = Article()
        parser.feed(pages[r.page_id].html or "")
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, "\n\n".join(parser.blocks), len("\n\n".join(parser.blocks)))


LONG = "Long text of an article. " * 12


@pytest.mark.parametrize(
    "page",
    [
        f'<article class="post comments-open"><p>{LONG}</p><p>End</p></article>',
        f'<div class="social-science"><p>{LONG}</p><p>End</p></div>',
        f'<div class="has-sidebar"><nav>Menu</nav><p>{LONG}</p><p>End</p><div class="sidebar">Side</div></div>',
        f'<div id="page" class="no-ads"><p>{LONG}</p><p>End</p><div class="ad-banner"><p>Buy</p></div></div><div class="site-footer">Foot</div>',
        f'<section class="search-results"><p>{LONG}</p><p>End</p></section>',
        f'<article class="comment"><p>{LONG}</p><p>End</p></article><article class="comment"><p>Short</p></article>',
        f'<p>{LONG}</p><p>End</p><ul><li><a href="a">Link one</a><li><a href="b">Link two</a><li><a href="c">Link three</a></ul><p>Away</p>',
        f'<article><p>{LONG}</p><p>End</p><section id="comments"><article><p>{LONG * 3}</p></article></section></article>',
        # no article: menu and footer in plain divisions
        f"<div>Home</div><div>About us</div><div>Contact</div><div><p>{LONG}</p><p>End</p></div><div>Copyright 2020</div><div>Imprint</div>",
        # lists of links in the middle end nothing and aren't text
        f'<div><p>{LONG}</p><ul><li><a href="a">One</a><li><a href="b">Two</a></ul><p>End</p></div>',
        f'<div><p>{LONG}</p><ul><li><a href="a">One</a><li><a href="b">Two</a><li><a href="c">Three</a><li><a href="d">Four</a></ul><p>End</p></div>',
        # a class that misleads, and an article that is a teaser
        f'<main><div class="search"><p>{LONG}</p><p>End</p></div></main>',
        f'<div class="advert"><p>{LONG}</p><p>End</p></div><div>Other</div>',
        f'<article><p>More on this.</p></article><div class="content"><p>{LONG}</p><p>End</p></div>',
        f'<article><p>{LONG}</p><div class="ad">Buy now</div><p>End</p></article><div class="ad">{LONG}</div>',
    ],
)
def test_html_parts(page):
    assert main_text(f"<html><body>{page}</body></html>") == f"{LONG.strip()}\n\nEnd"


def test_html_windows_decide(monkeypatch):
    """Surges and dives, the level from the page, and that all inside an article isn't the answer."""
    assert html.stretches(np.array([0, 9, 4, 5, 0, 5, 5, 0, 8.0]), 8) == [(1, 4), (8, 9)]
    assert html.surge_level(np.array([10.0, 10, 100]), np.array([20.0, 120, 110])) == 27.5 and html.surge_level(np.array([1e4, 1e3]), np.array([1e4, 1e4])) == 500
    two = f"<article><p>More on this.</p></article><article><p>{LONG}</p><p>End</p></article><article><p>And this.</p></article>"
    assert main_text(two) == f"{LONG.strip()}\n\nEnd"
    monkeypatch.setattr(html, "surge_level", lambda *_: 0.0)
    assert main_text(two) != f"{LONG.strip()}\n\nEnd"


def test_html(spark):
    assert main_text(PAGE) == "Head & title\n\nOne two three été\n\n1 < 2 and a > b\n\nLast"
    plain = "<body><ul><li>a</li><li>b</li></ul><div>" + "Long text. " * 20 + "</div><p>short</p><div class='footer'>Foot</div></body>"
    assert main_text(plain).endswith("short") and "Foot" not in main_text(plain)
    assert main_text("<article><p>Short.</p></article>") == "Short." and main_text("<p>" + "a" * 10**6) == "a" * 10**6
    assert main_text("<article><p>A b.</p>" + "<p><a href='x'>only links</a></p>" * 9 + "<p>c</p></article>").count("only links") == 9
    assert [main_text(x) for x in (None, "", "<p", "<script>x", "<article></article>", "<nav>Home</nav>")] == [""] * 6
    frame = spark.createDataFrame([(1, PAGE, "old"), (2, None, "old"), (1, PAGE, "old")], "page_id long, html string, main_text string")
    assert sorted(len(r.main_text) for r in extract(frame).collect()) == [0, len(main_text(PAGE)), len(main_text(PAGE))]


def test_warc(spark, tmp_path):
    pages = [(i, f"http://h/{i}\r\nX: y" if i % 2 else None, h) for i, h in enumerate(["<p>a</p>\r\n\r\nWARC/1.1\r\n", "b", "b", "", None, "é" * 5000, "b"])]
    frame = spark.createDataFrame(pages + [(None, "u", "b")], "page_id long, url string, html string").repartition(3)
    files = warc.write(frame, str(tmp_path / "w"))
    got = {r.record_id: r for r in warc.read(files).collect()}
    for i, _, h in pages:
        own = (h or "").encode()
        first = next(j for j, _, g in pages if (g or "") == (h or ""))
        r = got[f"urn:page:{i}"]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(own), warc.digest(own), "response" if i == first else "revisit", None if i == first else f"urn:page:{first}")
        assert r.payload == (own if i == first else None)
    assert got["urn:page:"].record_type == "response"
    assert warc.read(warc.write(frame.limit(0), str(tmp_path / "e"))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(tmp_path, packed):
    rng = random.Random(2)
    records = [warc.record("response", f"r{i}", "u", bytes(rng.choices(range(256), k=rng.choice((0, 50, 90_000)))), "", None) for i in range(9)]
    stored = [warc.member(r) if packed else r for r in records]
    harm = {2: lambda b: b[: len(b) // 2], 5: lambda b: b[:-10] + b"\x00\x01" + b[-8:], 7: lambda b: b"junk" + b}
    whole = b"".join(harm.get(i, lambda b: b)(b) for i, b in enumerate(stored))
    path = tmp_path / "a"
    path.write_bytes(whole)
    with path.open("rb") as f:
        rows = list(warc.salvage("a", f))
    found = {r["record_id"] for r in rows if r["record_type"] == "response"}
    assert found >= {f"r{i}" for i in (0, 1, 3, 4, 6, 7, 8)} and not found & {"r2", "r5"}
    gaps = [r for r in rows if r["record_type"] == "gap"]
    assert len(gaps) >= 2 and all(r["gap_bytes"] > 0 and r["reason"] for r in gaps)


def salvaged(data):
    rows = list(warc.salvage("a", io.BytesIO(data)))
    return [r["record_id"] for r in rows if r["record_type"] != "gap"], [r for r in rows if r["record_type"] == "gap"]


def test_warc_plain_of_several_mb():
    rng = random.Random(5)
    sizes = [100_000] * 45 + [3_000_000, 10, 70_000, 2_500_000, 100_000]
    records = [warc.record("response", f"r{i}", "u", rng.randbytes(n), "", None) for i, n in enumerate(sizes)]
    found, gaps = salvaged(b"".join(records))
    assert found == [f"r{i}" for i in range(len(sizes))] and not gaps
    # a damaged length reaches past the end, a lost end takes the last record only
    records[20] = re.sub(rb"Content-Length: 1", b"Content-Length: 99999999999", records[20], count=1)
    found, gaps = salvaged(b"".join(records)[:-10])
    assert found == [f"r{i}" for i in range(len(sizes) - 1) if i != 20] and len(gaps) == 2


def test_warc_long_headers(spark, tmp_path):
    pages = [(1, "data:," + "x" * 70_000, "a"), (2, "data:," + "y" * 3_000_000, "b"), (3, "u", "c")]
    files = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.record_id: (r.target_uri, r.payload) for r in warc.read(files).collect()}
    assert got == {f"urn:page:{i}": (u, bytearray(h.encode())) for i, u, h in pages}
    found, gaps = salvaged(b"".join(warc.record("response", f"r{i}", u, h.encode(), "", None) for i, u, h in pages))
    assert found == ["r1", "r2", "r3"] and not gaps


@pytest.mark.parametrize("size", [300, 30_000])
def test_warc_members_of_several_records(size):
    rng = random.Random(size)
    records = [warc.record("response", f"r{i}", "u", rng.randbytes(size).hex().encode(), "", None) for i in range(60)]
    names, ends = [f"r{i}" for i in range(60)], [len(b"".join(records[: i + 1])) for i in range(60)]
    whole, after = warc.member(b"".join(records)), warc.member(warc.record("response", "after", "u", b"x", "", None))
    assert salvaged(whole + after) == ([*names, "after"], [])
    # one record fails its check, in a sound member
    harmed = list(records)
    harmed[25] = harmed[25].replace(b"Content-Length", b"Content Length")
    harmed[40] = harmed[40][:-5] + b"\x00" + harmed[40][-4:]
    found, gaps = salvaged(warc.member(b"".join(harmed)) + after)
    assert found == [x for x in names if x not in ("r25", "r40")] + ["after"]
    assert [g["gap_bytes"] for g in gaps] == [len(harmed[25]), len(harmed[40])] and all(g["start"] == 0 for g in gaps)
    # the end is lost, or bytes in the middle: what was unpacked before is kept
    for cut in (len(whole) // 3, len(whole) * 2 // 3, len(whole) - 9):
        sound = len(zlib.decompressobj(31).decompress(whole[:cut]))
        expected = [x for x, end in zip(names, ends, strict=True) if end <= sound]
        assert expected and salvaged(whole[:cut])[0] == expected
        found, gaps = salvaged(whole[:cut] + after)
        assert found == [*expected, "after"] and len(gaps) == 1
        # later records of the member may read well again
        found, gaps = salvaged(whole[:cut] + b"\xff" * 64 + whole[cut + 64 :] + after)
        assert found[: len(expected)] == expected and found[-1] == "after" and gaps
        assert [x for x in [*names, "after"] if x in found] == found


def test_licenses(spark, docs):
    mit = licenses.TEMPLATES[1][1]
    rows = [(1, "x y z " * 30 + mit + " more " * 40), (2, "Released under the MIT license!\nother"), (3, None), (4, ""), (5, mit.replace("charge", "cost")), (6, "released under the"), (2, "again"), (None, mit)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, template string")
    got = [(r.doc_id, r.templates) for r in licenses.by_document(frame, licenses.default_templates(spark)).collect()]
    found = dict(got)
    assert len(got) == len(rows)
    assert found[1] == ["MIT-text"] and found[2] == ["MIT"] and found[3] == found[4] == found[6] == [] and found[5] == ["MIT-text"]
    assert licenses.by_document(frame.limit(0), licenses.default_templates(spark)).count() == 0


def test_licenses_in_parts(spark):
    words = licenses.TEMPLATES[1][1].split()
    half, other = " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 - 4 :])
    far = " ".join(f"w{i}" for i in range(400))
    again = " ".join(f"{a} b c d e" for a in "xyxyxyxyxyxyxyxyxyxyxyxyxyxyxyxy") + " the rest of it is said only once here"
    rows = [(1, f"{half} {far} {other}"), (2, f"{far} {half} {far}"), (3, half), (3, other), (4, f"{far} {again} {far}")]
    templates = licenses.default_templates(spark).unionByName(spark.createDataFrame([("again", again)], "template string, text string"))
    got = {(r.doc_id, r.template): r.contained for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    sets = lambda *texts: {tuple(w[i : i + 5]) for t in texts for w in [re.findall(r"[a-z0-9]+", t.lower())] for i in range(len(w) - 4)}
    by_id: dict[int, list[str]] = {}
    for d, t in rows:
        by_id.setdefault(d, []).append(t)
    expected = {}
    for d, texts in by_id.items():
        for name, text in [*licenses.TEMPLATES, ("again", again)]:
            common = len(sets(*texts) & sets(text))
            if 100 * common >= 80 * len(sets(text)):
                expected[d, name] = common
    assert set(expected) == {(1, "MIT-text"), (3, "MIT-text"), (4, "again")} and got == expected


@pytest.mark.parametrize("tokenizer", [None, "byte_bpe_50k.json"])
def test_chat(spark, tokenizer):
    if tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s><s>\\<\\s>"), (2, 0, "user", "hi"), (2, 1, "assistant", "b"), (2, 2, "user\n<s>", None), (3, 0, None, "<\\\\/s>"), (3, 0, None, "<\\\\/s>"), (None, 0, "user", "x"), (4, 5, "assistant", "é"), (4, 2, "assistant", "first"), (5, 0, "user", "hi")]
    frame = spark.createDataFrame([(*r, "x") for r in said], "conv_id long, turn long, role string, text string, node string")
    stream, segments, of = chat.chat_format(frame, tokenizer)
    got = {r.conv_id: r for r in chat.read_back(stream, segments, of, tokenizer).collect()}
    assert len(got) == 6
    for conv in (1, 2, 3, 4, 5, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in said if c == conv), key=lambda v: v)
        trained = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())
    rows = sorted(stream.collect(), key=lambda r: r.stream_start)
    assert len(rows) == 9  # the greetings are one node
    told = {bytes(r.segment): r for r in segments.collect()}
    at = 0
    spans = {}
    for r in rows:
        s = told[bytes(r.segment)]
        assert r.stream_start == at and len(r.ids) == r.n_tokens * (2 if tokenizer else 1)
        covered = {i for a in s.ancestors for i in range(a.start, a.end)}
        assert s.position_start == len(covered)
        covered |= set(range(s.segment_start, r.stream_start))
        assert covered == {i for b in (spans[n] for n in nodes_of(of, r.node)) for i in range(*b)}
        spans[bytes(r.node)] = (at, at + r.n_tokens)
        at += r.n_tokens
    # a wrong interval or position can't be read back
    for wrong in (
        segments.withColumn("ancestors", F.transform("ancestors", lambda s: F.struct((s.start + 1).alias("start"), s.end.alias("end")))),
        segments.withColumn("position_start", F.col("position_start") + 1),
    ):
        with pytest.raises(Exception, match="is next"):
            chat.read_back(stream, wrong, of, tokenizer).collect()
    assert chat.read_back(*chat.chat_format(frame.limit(0), tokenizer), tokenizer).count() == 0


def nodes_of(of, node):
    """The nodes of one conversation that holds the node, down to it."""
    conv, k = of.where(F.col("node") == F.lit(bytes(node))).select("conv_id", "k").first()
    return [bytes(r.node) for r in of.where(F.col("conv_id").eqNullSafe(conv)).where(F.col("k") < k).collect()]


def test_chat_of_a_long_and_a_common_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "SHARED", 20)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(3000)]
    rows += [(c, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for c in range(2, 300) for i in range(3 + c % 2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    stream, segments, of = chat.chat_format(frame)
    assert stream.count() == 3000 and segments.count() == 3
    got = {r.conv_id: r for r in chat.read_back(stream, segments, of).collect()}
    for conv in (1, 2, 3, 299):
        own = [(r, x) for c, _, r, x in rows if c == conv]
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
    assert len(got) == 299


def test_packing(spark, docs, texts):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = {900: "It's a?! ÉCOLE… x'll. 3.14, <|endoftext|>z; é İ K", 901: None}
    frame = docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates().unionByName(spark.createDataFrame(list(odd.items()), "doc_id long, text string"))
    rows = packing.pack(frame.repartition(3), path, size=256).collect()
    for i, t in (texts | odd).items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], np.uint32)
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == ids.tobytes() and {r.doc_tokens for r in own} == {len(ids)}
        assert [r.start for r in own] == [sum(q.length for q in own[:j]) for j in range(len(own))]
        assert zlib.crc32(own[0].ids) >= 0
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:j]) for j in range(len(w))] and sum(n for _, n in w) <= 256
    assert sum(sum(n for _, n in w) < 256 for w in windows.values()) <= 3
    assert packing.pack(frame.limit(0), path).count() == 0


def test_sum_of_squares():
    packer = packing.Packer(8, 0)
    packer.count[[2, 5]] = [3, 1]
    assert packer.level_for(3) == 2  # 4 + 4 against 9 (filling 5) and 9 + 1 + 1 (new)
    packer.count[:] = 0
    packer.count[[4, 6]] = [1, 2]
    assert packer.level_for(1) == 6  # 1 + 1 + 1 against 4 + 1 (level 5) and 1 + 4 + 1 (new)


def test_buckets_follow_the_texts(spark, docs):
    """A join's estimate multiplies its sides; the number of buckets doesn't."""
    joined = docs.join(docs.select("doc_id", "source").withColumnRenamed("source", "other"), "doc_id").join(docs.select("doc_id").distinct(), "doc_id", "left")
    assert exchange.bucket_count(joined) == exchange.bucket_count(docs) == 4 and exchange.bucket_count(docs.limit(0)) == 4
    got = {r.doc_id: r.kept for r in remove_repeats(joined.drop("kept").where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])).collect()}
    assert got == {r.doc_id: r.kept for r in remove_repeats(docs.where("doc_id IS NOT NULL")).collect()}
