"""Texts are worked on once for each spelling."""

from pyspark.sql import functions as F

from cotejo.operators import matching, reconcile


def test_texts_are_made_once_for_each_spelling(spark):
    source = spark.range(1, 61).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "Dir. de Área").otherwise("DIRECCIÓN DE AREA").alias("puesto_original"), F.when(F.col("id") % 3 == 0, "Nivel 40").alias("nivel_original"))
    spelled = matching.spellings(source).collect()
    assert sorted((r["title"], r["level_text"] or "", r["seq"], r["n"]) for r in spelled) == [("DIRECCIÓN DE AREA", "", 1, 20), ("DIRECCIÓN DE AREA", "Nivel 40", 3, 10), ("Dir. de Área", "", 2, 20), ("Dir. de Área", "Nivel 40", 6, 10)]
    firsts = matching.representatives(source).collect()
    assert [(r["seq"], r["title"], r["level"], r["n"]) for r in firsts] == [(1, "DIRECCIÓN DE AREA", "", 60)]


def test_records_of_a_spelling_without_level_are_duplicates(spark):
    source = spark.createDataFrame([(1, "Asesor", None), (2, "Asesor", None), (3, "asesor", "N43"), (4, "Enlace", None)], "seq long, puesto_original string, nivel_original string")
    found = {r["seq"]: r for r in reconcile.duplicates(source, "Excel").collect()}
    assert sorted(found) == [1, 2, 3] and {r["n"] for r in found.values()} == {3} and {r["first"] for r in found.values()} == {1}
    assert found[3]["detail"] == "Puesto duplicado 3 veces dentro de Excel. Ubicaciones: fila=1; fila=2; fila=3"


def test_joins_on_keys_read_saved_representatives(spark):
    source = spark.createDataFrame([(1, "Asesor", None), (2, "Enlace", "21")], "seq long, puesto_original string, nivel_original string")
    firsts = matching.representatives(source)
    assert firsts.inputFiles()  # else the join's filter on keys makes them for each record
    assert [(r["o_key"], r["o_seq"]) for r in matching.exact_pairs(firsts, firsts.where("seq = 2")).collect()] == [("enlace", 2)]
