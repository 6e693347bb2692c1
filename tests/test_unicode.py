"""Folding of every code point, against the standard library."""

import unicodedata

from pyspark.sql import functions as F

from cotejo.functions import text


def nfkd(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_every_code_point(spark):
    rows = [(c, f"a{chr(c)}b") for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wrong = [(hex(c), got) for c, got in spark.createDataFrame(rows, "c int, t string").select("c", text.strip_accents(F.col("t")).alias("got")).toLocalIterator() if got != nfkd(f"a{chr(c)}b")]
    assert wrong == []


def test_titles(spark):
    titles = ["Dirección GENERAL", "№ 4 ½ ﬁn", "ŀlana ǅ Ⅳ", "Ελληνικά ΐ", "Ёлка й", "한국어 값", "a b　c\x1cd", "q́ ̧", "‘x’ – “y”", "x´y", None, "İI", "…", "a b"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").select("i", text.normalise_title(F.col("t")).alias("n")).collect()
    assert {titles[r.i]: r.n for r in got} == {t: text.normalised(t) for t in titles}
