"""The pipeline's stages on a fixture: what each keeps, and that the last one packs exactly what is left."""

import random

import corpus_pipeline as cp


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 7))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    text = {i: words(rng, 80) for i in range(12)}
    passage, item = words(rng, 60), words(rng, 30)
    text[3] += " " + passage
    text[7] = passage + " " + text[7]
    text[20] = text[1]
    text[21] = text[2] + " end"
    text[22] = "spam eggs " * 200
    text[23] = "short"
    text[9] += " " + item
    rows = [(i, t, "en", "s", len(t)) for i, t in text.items()] + [(30, None, "en", "s", None), (1, text[1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        if k < len(cp.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 2:
            left = {r.doc_id: r.text for r in docs.collect()}
            assert left[3] == text[3] and passage not in left[7] and left[7].split() == text[7].split()[60:]
    assert seen[0] == sorted([*range(12), 1, 20, 21])
    assert seen[1] == list(range(12))
    assert seen[2] == list(range(12))
    assert seen[3] == [i for i in range(12) if i != 9]
    assert set(seen[4]) == set(seen[3])
    assert cp.run(spark, str(tmp_path)).selectExpr("sum(length)").first()[0] == docs.selectExpr("sum(length)").first()[0]


def test_rows_that_share_a_doc_id_or_have_none(spark):
    """Different texts under one doc_id and rows without doc_id are judged by themselves."""
    rng = random.Random(4)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(5, a), (5, b), (5, b), (1, b), (None, c), (None, c), (None, d), (9, d), (7, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = cp.near_dedup(spark, docs, "").collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got)) == sorted([(False, 5, a), (False, 1, b), (True, 0, c), (False, 9, d), (False, 7, ""), (True, 0, "")])
