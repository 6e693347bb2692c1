"""Queries against their SQL on the smallest tables."""

import math

import duckdb

from cotejo import catalogue
from cotejo.operators import lines, reconcile

SMALL = "/root/testdata/sf0.001"


def check(spark, name, folder=SMALL, tables=("part",)):
    got = catalogue.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    asked = con.execute(catalogue.ORACLES[name])
    assert got.columns == [c[0] for c in asked.description]
    key = lambda r: tuple((x is None, round(x, 6) if isinstance(x, float) and math.isfinite(x) else str(x)) for x in r)
    assert sorted(map(repr, map(key, got.collect()))) == sorted(map(repr, map(key, asked.fetchall())))


def test_duplicates_have_the_columns_of_their_sql(spark):
    check(spark, "dup_fanout")


def test_a_line_is_normalised_once(monkeypatch):
    asked = []
    monkeypatch.setattr(lines, "normalised", lambda t: asked.append(t) or t)
    assert not lines._noise("Enlace 20") and asked == ["Enlace 20"]


def test_details_of_duplicates_are_left_to_those_who_ask(spark, tmp_path):
    """What is saved and shuffled of the results doesn't grow with the square of a group of equal titles."""
    n = 400
    source = spark.createDataFrame([(i, "Enlace de Apoyo", "20") for i in range(n)], "seq long, puesto_original string, nivel_original string")
    results, told = reconcile.short_sections({"excel": source, "organigrama": source})
    assert results.where("section = -1 AND detail IS NULL").count() == 2 * n and told.count() == 2
    details = {r.detail for r in reconcile.with_places(results, told).where("section = -1").collect()}
    assert len(details) == 2 and all(d.count("fila=") == n for d in details)
