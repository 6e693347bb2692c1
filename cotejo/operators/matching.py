"""Matching of two sources: equal keys, similar keys, and a one-to-one assignment of all."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo import config
from cotejo.functions import catalogue, similarity, text
from cotejo.operators.likeness import similar_pairs
from cotejo.plans.graphs import components
from cotejo.plans.saved import saved


def spellings(source: DataFrame) -> DataFrame:
    """(title, level_text, seq, n, normalised, level): the spellings of titles and levels of a source, each with its first record and number of records.

    Records are many where spellings are few, and the functions of texts are dear, so they are made once for each spelling.
    """
    spelled = source.groupBy(F.col("puesto_original").alias("title"), F.col("nivel_original").alias("level_text")).agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    return spelled.withColumns({"normalised": text.normalise_title(F.col("title")), "level": text.normalise_level(F.col("level_text"))})


def representatives(source: DataFrame) -> DataFrame:
    """(key, seq, title, normalised, level, level_text, n): the first record of each comparison key of a source.

    source has seq, puesto_original and nivel_original.  A title of signs alone has the key '', which is a key like others.
    They are saved: a join on the key would have it made for each record, to leave out nulls before they are grouped.
    """
    keyed = spellings(source).select(text.comparison_key(F.col("title")).alias("key"), F.struct("seq", "title", "normalised", "level", "level_text").alias("record"), "n")
    grouped = keyed.groupBy("key").agg(F.min("record").alias("record"), F.sum("n").alias("n"))
    return saved(grouped.select("key", "record.*", "n"))


def exact_pairs(origin: DataFrame, target: DataFrame) -> DataFrame:
    """(o_key, d_key, o_seq, d_seq, score, level, reason) of equal keys."""
    o = origin.select(F.col("key"), F.col("seq").alias("o_seq"))
    d = target.select(F.col("key"), F.col("seq").alias("d_seq"))
    return o.join(d, "key").select(F.col("key").alias("o_key"), F.col("key").alias("d_key"), "o_seq", "d_seq", F.lit(100.0).alias("score"), F.lit("normalizada").alias("level"), F.lit("").alias("reason"))


#: Shares of letters without partner that a match can have: of names that follow one category, and of whole titles.
NAMES, TITLES = 1 - (config.REVIEW - config.BONUS) / 100, 1 - config.REVIEW / 100


def _strings(side: DataFrame, name: Column, block: Column, slack: float) -> DataFrame:
    """What similar_pairs needs of a side (id, key, kind): names as sorted words, and hashes of modifiers and suffixes, which must not differ."""
    tail = F.coalesce(F.xxhash64(text.suffix(name)), F.lit(0).cast("long"))
    return side.select(block.alias("block"), "id", similarity.sorted_words(name).alias("word"), F.lit(slack).alias("slack"), F.xxhash64(F.array_join(text.modifiers(name), ",")).alias("mods"), F.when(text.suffix(name).isNull(), 0).otherwise(tail).cast("long").alias("tail"))


def fuzzy_pairs(origin: DataFrame, target: DataFrame) -> DataFrame:
    """(o_key, d_key, o_seq, d_seq, score, level, reason) of similar keys among those without an equal one.

    A conflict of categories, modifiers or suffixes costs more than a match can spare.  So titles of one category are
    compared by what follows it, and titles outside the catalogue with all; titles of two categories never match.
    """
    numbered = lambda df: saved(df.select("key", "seq", catalogue.category(F.col("key")).alias("kind"), F.monotonically_increasing_id().alias("id")))
    o, d = numbered(origin.join(target.select("key"), "key", "left_anti")), numbered(target.join(origin.select("key"), "key", "left_anti"))
    rest, whole, known = catalogue.specific_name(F.col("key")), F.col("key"), F.col("kind").isNotNull()
    left = _strings(o.where(known), rest, F.col("kind"), NAMES).unionByName(_strings(o, whole, F.when(known, "known with unknown").otherwise("unknown with all"), TITLES))
    right = _strings(d.where(known), rest, F.col("kind"), NAMES).unionByName(_strings(d, whole, F.lit("unknown with all"), TITLES)).unionByName(_strings(d.where(~known), whole, F.lit("known with unknown"), TITLES))
    found = saved(similar_pairs(left, right))
    pairs = found.join(o.select(F.col("id").alias("o_id"), F.col("key").alias("o_key"), F.col("seq").alias("o_seq")), "o_id").join(d.select(F.col("id").alias("d_id"), F.col("key").alias("d_key"), F.col("seq").alias("d_seq")), "d_id")
    scored = similarity.compare(pairs, "o_key", "d_key")
    return scored.where(F.col("level").isin("fuzzy_alta", "revision")).select("o_key", "d_key", "o_seq", "d_seq", "score", "level", "reason")


#: Pairs of a component that one task takes in order; larger components go by rounds.
COMPONENT = 1 << 18


def _in_order(pairs: DataFrame) -> DataFrame:
    """assign's choice within each component, whose pairs one task walks in order."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_exact=pdf["level"] != "normalizada", _score=-pdf["score"]).sort_values(["_exact", "_score", "o_seq", "d_seq", "o_key", "d_key"])
        used: tuple[set, set] = (set(), set())
        keep = []
        for o, d in zip(pdf["o_key"], pdf["d_key"], strict=True):
            keep.append(o not in used[0] and d not in used[1])
            if keep[-1]:
                used[0].add(o)
                used[1].add(d)
        return pdf[keep].drop(columns=["_exact", "_score", "component"])

    return pairs.groupBy("component").applyInPandas(walk, pairs.drop("component").schema)


def _by_rounds(pairs: DataFrame) -> DataFrame:
    """assign's choice, taking in each round the pairs that are best for both ends."""
    order = [(F.col("level") == "normalizada").desc(), F.col("score").desc(), F.col("o_seq"), F.col("d_seq"), F.col("o_key"), F.col("d_key")]
    left, found = pairs, []
    while not left.isEmpty():
        ranked = left.withColumn("_o", F.row_number().over(Window.partitionBy("o_key").orderBy(*order))).withColumn("_d", F.row_number().over(Window.partitionBy("d_key").orderBy(*order)))
        found.append(saved(ranked.where("_o = 1 AND _d = 1").drop("_o", "_d")))
        left = saved(left.join(found[-1].select("o_key"), "o_key", "left_anti").join(found[-1].select("d_key"), "d_key", "left_anti"))
    return reduce(lambda a, b: a.unionByName(b), found, pairs.limit(0))


def assign(pairs: DataFrame, most: int = COMPONENT) -> DataFrame:
    """A one-to-one choice: pairs in the order of exactness, score, o_seq and d_seq, each if both ends are free.

    Up to ``most`` pairs are taken in order in one task.  Of more, those of different components of the graph of candidates don't meet, so
    each component of up to ``most`` pairs is taken so, however long its chains are; larger ones go by rounds of the pairs that are best for both ends.
    """
    pairs = saved(pairs)
    if pairs.limit(most + 1).count() <= most:
        return _in_order(pairs.withColumn("component", F.lit(0).cast("long")))
    node = lambda side: F.xxhash64(F.lit(side), F.col(f"{side}_key"))
    labels = components(pairs.select(node("o").alias("a"), node("d").alias("b")))
    labelled = saved(pairs.withColumn("node", node("o")).join(labels, "node").drop("node"))
    large = labelled.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most).select("component")
    if large.isEmpty():
        return _in_order(labelled)
    large = saved(large)
    return _in_order(labelled.join(large, "component", "left_anti")).unionByName(_by_rounds(saved(labelled.join(large, "component", "left_semi").drop("component"))))


def match(origin: DataFrame, target: DataFrame) -> DataFrame:
    """The assignment of two sources' representatives.  Equal keys pair only with each other, so only similar ones are assigned."""
    return exact_pairs(origin, target).unionByName(assign(fuzzy_pairs(origin, target)))


def name_level(level: Column, title_a: Column, title_b: Column, norm_a: Column, norm_b: Column) -> Column:
    """0 to 4 of NAME_LEVELS for a pair's level and its titles; null for no pair."""
    exact = F.when(title_a == title_b, 0).when(norm_a == norm_b, 1).otherwise(2)
    return F.when(level == "normalizada", exact).when(level == "fuzzy_alta", 3).when(level == "revision", 4)


def level_name(rank: Column) -> Column:
    names = F.array(*map(F.lit, config.NAME_LEVELS))
    return F.coalesce(F.try_element_at(names, rank + 1), F.lit(config.NO_NAME))


def method_name(rank: Column) -> Column:
    names = F.array(*map(F.lit, config.METHODS))
    return F.coalesce(F.try_element_at(names, rank + 1), F.lit(config.NO_METHOD))
