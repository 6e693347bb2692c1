"""Comparison by ID: positions, order, direct superiors and the rows left over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions import text

#: Width of the ranges of seq that are ranked apart.
WIDTH = 65_536


def with_position(records: DataFrame, seq: str = "seq") -> DataFrame:
    """records with position, the rank of seq from 1.

    Ranges of seq are ranked apart and the ranges' counts are summed, so no task holds all rows.
    """
    ranged = records.withColumn("_range", F.floor(F.col(seq) / WIDTH))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    local = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(seq)))
    return local.join(before, "_range").withColumn("position", F.col("_before") + F.col("_rank")).drop("_range", "_rank", "_before")


def id_problems(reference: DataFrame) -> DataFrame:
    """reference (seq, id_text) with id_excel, n_same and error_id: missing, invalid or repeated IDs."""
    parsed = reference.withColumn("id_excel", text.parse_id(F.col("id_text")))
    counts = parsed.where("id_excel IS NOT NULL").groupBy("id_excel").agg(F.count("*").alias("n_same"))
    found = parsed.join(counts, "id_excel", "left")
    error = F.when(F.col("id_excel").isNull(), "ID ausente o no válido").when(F.col("n_same") > 1, "ID duplicado").otherwise("")
    return found.select("seq", "id_text", "id_excel", F.coalesce("n_same", F.lit(0).cast("long")).alias("n_same"), error.alias("error_id"))


def resolve_boss(reference: DataFrame) -> DataFrame:
    """(seq, id_excel, boss): the title of the one row that the boss's ID names, or a note that there is none; null without a boss.

    reference has seq, id_excel, jefe_id and puesto_original.
    """
    one = reference.where("id_excel IS NOT NULL").groupBy("id_excel").agg(F.count("*").alias("n"), F.min("puesto_original").alias("boss_title")).where("n = 1")
    joined = reference.join(one.select(F.col("id_excel").alias("jefe_id"), "boss_title"), "jefe_id", "left")
    boss = F.when(F.col("jefe_id").isNull(), None).otherwise(F.coalesce("boss_title", F.concat(F.lit("[ID de jefe no resoluble: "), F.col("jefe_id").cast("string"), F.lit("]"))))
    return joined.select("seq", "id_excel", boss.alias("boss"))


def positional(reference: DataFrame, source: DataFrame) -> DataFrame:
    """Each reference row with the source's record at the position that its ID names: id_excel, seq, found_seq, same_name, same_level."""
    placed = with_position(source).select(
        F.col("position").alias("id_excel"), F.col("seq").alias("found_seq"), text.comparison_key(F.col("puesto_original")).alias("found_key"), text.normalise_level(F.col("nivel_original")).alias("found_level")
    )
    keyed = reference.select("seq", "id_excel", text.comparison_key(F.col("puesto_original")).alias("key"), text.normalise_level(F.col("nivel_original")).alias("level"))
    return keyed.join(placed, "id_excel", "left").select(
        "id_excel", "seq", "found_seq", F.coalesce(F.col("key") == F.col("found_key"), F.lit(False)).alias("same_name"), F.coalesce(F.col("level") == F.col("found_level"), F.lit(False)).alias("same_level")
    )


def order_state(reference: DataFrame, source: DataFrame) -> DataFrame:
    """(id_excel, seq, state, detail) of each reference row in a verified source.

    The record at the position of the ID is the row's; where its name differs, one record of that
    name elsewhere is 'Diferente posición', several are 'Coincidencia ambigua' (narrowed to equal
    levels where there are some), none is 'Puesto no encontrado'.
    """
    placed = with_position(source).select("position", text.comparison_key(F.col("puesto_original")).alias("key"), text.normalise_level(F.col("nivel_original")).alias("level"))
    by_level = placed.groupBy("key", "level").agg(F.count("*").alias("n_level"), F.min("position").alias("at_level"))
    by_key = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("position").alias("at"))
    rows = reference.select("seq", "id_excel", text.comparison_key(F.col("puesto_original")).alias("key"), text.normalise_level(F.col("nivel_original")).alias("level"))
    rows = rows.join(placed.select(F.col("position").alias("id_excel"), F.col("key").alias("found_key")), "id_excel", "left").join(by_key, "key", "left").join(by_level, ["key", "level"], "left")
    n, at = F.coalesce("n_level", "n"), F.coalesce("at_level", "at")
    state = (
        F.when(F.col("id_excel").isNull(), "Revisar ID de Excel")
        .when(F.col("key") == F.col("found_key"), "Misma posición")
        .when(n == 1, "Diferente posición")
        .when(n > 1, "Coincidencia ambigua")
        .otherwise("Puesto no encontrado")
    )
    detail = F.when(state == "Diferente posición", F.concat(F.lit("posición "), at.cast("string"), F.lit("; esperada "), F.col("id_excel").cast("string"))).otherwise("")
    return rows.select("id_excel", "seq", state.alias("state"), detail.alias("detail"))


def leftovers(reference: DataFrame, source: DataFrame) -> DataFrame:
    """(seq, position) of the source's records that no reference ID names."""
    return with_position(source).join(reference.where("id_excel IS NOT NULL").select(F.col("id_excel").alias("position")), "position", "left_anti").select("seq", "position")


def verifiable(source: DataFrame) -> DataFrame:
    """One row: how many records, how many valid, and whether the source's positions can be relied on (all valid, at least one)."""
    ok = F.coalesce(F.trim("puesto_original") != "", F.lit(False))
    return source.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"), (F.coalesce(F.every(ok), F.lit(False))).alias("verifiable"))


def boss_state(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(id_excel, state): expected (id_excel, boss) against found (id_excel, boss), names compared by key.

    A boss whose title several reference rows have is ambiguous.
    """
    titles = expected.where("title IS NOT NULL").groupBy(text.comparison_key(F.col("title")).alias("boss_key")).agg(F.count("*").alias("n_titles"))
    e = expected.select("id_excel", "boss", text.comparison_key(F.col("boss")).alias("boss_key")).join(titles, "boss_key", "left")
    f = found.select("id_excel", F.col("boss").alias("found_boss"), text.comparison_key(F.col("boss")).alias("found_key"))
    joined = e.join(f, "id_excel", "left")
    state = (
        F.when(F.col("found_boss").isNull(), "No verificable")
        .when(F.col("boss").isNull(), "Sin referencia en Excel")
        .when(F.col("n_titles") > 1, "Jefe ambiguo")
        .when(F.col("boss_key") == F.col("found_key"), "Coincide")
        .otherwise("Jefe inmediato diferente")
    )
    return joined.select("id_excel", state.alias("state"))
