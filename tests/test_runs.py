"""Words of a line are joined before they are dealt."""

from pyspark.sql import functions as F

from cotejo.operators import blocks

WORDS = "file string, page int, block int, par int, line_no int, word long, text string, left int, top int, width int, height int"


def test_words_of_a_line_are_joined_before_they_are_dealt(spark):
    words = spark.range(0, 24, numPartitions=1).select(F.lit("f").alias("file"), F.lit(1).alias("page"), F.lit(0).alias("block"), F.lit(0).alias("par"), F.floor(F.col("id") / 8).alias("line_no"), F.col("id").alias("word"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), *[F.col("id").alias(c) for c in ("x0", "y0", "x1", "y1")])
    runs = sorted(blocks._runs(words, ["file", "page", "block", "par", "line_no"], "word", " ", True).collect(), key=lambda r: r["word"])
    assert [(r["word"], r["text"], r["x0"], r["x1"]) for r in runs] == [(8 * k, " ".join(f"w{i}" for i in range(8 * k, 8 * k + 8)), 8.0 * k, 8.0 * k + 7) for k in range(3)]


def test_words_out_of_order_and_without_place_keep_their_line(spark):
    rows = [("f", 1, 0, 0, 0, 3, "c", 30, 0, 5, 5), ("f", 1, 0, 0, 0, 1, "a", None, 0, 5, 5), ("f", 1, 0, 0, 1, 4, "d", 0, 9, 5, 5), ("f", 1, 0, 0, 0, 2, "b", 20, 0, 5, 5), ("f", 1, 0, 0, 0, 5, " ", 0, 0, 5, 5), ("f", 1, 0, 0, None, 6, "e", 0, 0, 5, 5), ("f", 1, 0, 0, None, 7, "g", 0, 0, 5, 5)]
    lines = sorted(blocks.word_lines(spark.createDataFrame(rows, WORDS), dpi=72).collect(), key=lambda r: r["line"])
    assert [(r["line"], r["text"], r["x0"], r["x1"]) for r in lines] == [(1, "a b c", 20.0, 35.0), (4, "d", 0.0, 5.0), (6, "e g", 0.0, 5.0)]
