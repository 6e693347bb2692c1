"""Texts and ratios are made once where rows repeat titles."""

import pandas as pd

from cotejo.functions import similarity
from cotejo.operators import by_id
from cotejo.plans import report


def test_a_ratio_is_made_once_for_a_pair_of_titles(monkeypatch):
    asked, ratios = [], similarity.ratios
    monkeypatch.setattr(similarity, "ratios", lambda a, b: asked.extend(zip(a, b, strict=True)) or ratios(a, b))
    got = similarity.indel_ratio.func(pd.Series(["ab", "ab", "x", None, "ab", ""]), pd.Series(["abc", "abc", "x", "y", "ab", ""]))
    assert asked == [("ab", "abc")]
    assert [None if pd.isna(x) else round(x, 6) for x in got] == [80.0, 80.0, 100.0, None, 100.0, 100.0]


def test_records_take_their_texts_from_spellings(spark):
    rows = spark.createDataFrame([(1, "J.U.D. de  Ventas", "Nivel 25", None), (2, "J.U.D. de  Ventas", None, "J.U.D. de  Ventas"), (3, "Enlace", "Nivel 25", "Asesor"), (4, " ", "21", None)], "seq long, puesto_original string, nivel_original string, jefe_inmediato string")
    titles, levels = by_id._spelled([rows, rows.drop("jefe_inmediato")])
    assert (titles.count(), levels.count()) == (4, 2)
    got = {r.seq: (r.position, r.normalised, r.level, r.level_text, r.key, r.boss_key) for r in by_id._records(rows, titles, levels).collect()}
    unit = "jefatura de unidad departamental de ventas"
    assert got == {1: (1, "jud de ventas", "N25", "Nivel 25", unit, ""), 2: (2, "jud de ventas", "", None, unit, unit), 3: (3, "enlace", "N25", "Nivel 25", "enlace", "asesor")}


def test_reports_by_id_take_the_keys_of_records(spark):
    row = spark.sql("SELECT 'a' AS key, named_struct('title', 'A', 'key', 'a') AS excel, named_struct('title', 'B', 'key', 'b') AS organigrama")
    assert "regexp_replace" not in report.homologation(row, None, False)._jdf.queryExecution().analyzed().toString()


def test_ratios_of_batches_with_nulls():
    for n in range(4):
        for there in range(n + 1):
            got = similarity.indel_ratio.func(pd.Series(["ab"] * there + [None] * (n - there), dtype=object), pd.Series(["abc"] * n, dtype=object))
            assert [None if pd.isna(x) else round(x, 6) for x in got] == [80.0] * there + [None] * (n - there)
