"""Reconciliation of three sources by name: assignment, classification and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo import config
from cotejo.functions import catalogue, similarity, text
from cotejo.operators.matching import level_name, match, method_name, name_level, representatives, spellings
from cotejo.plans.saved import saved

SOURCES = ["excel", "word", "organigrama"]
NAMES = {"excel": "Excel", "word": "Word", "organigrama": "Organigrama"}
#: The order in which present sources are listed.
PRESENT = ["excel", "organigrama", "word"]


def is_valid(source: DataFrame) -> Column:
    no_error = F.col("error").isNull() if "error" in source.columns else F.lit(True)
    return no_error & (F.trim(F.coalesce("puesto_original", F.lit(""))) != "")


def valid(source: DataFrame) -> DataFrame:
    """Records with a title and without an error."""
    return source.where(is_valid(source))


def errors(source: DataFrame, name: str) -> DataFrame:
    """(source, seq, key, kind, detail) of the records that valid() leaves out."""
    told = F.col("error") if "error" in source.columns else F.lit(None).cast("string")
    left = source.where(told.isNotNull() | (F.trim(F.coalesce("puesto_original", F.lit(""))) == ""))
    return left.select(F.lit(name).alias("source"), "seq", F.lit("[ERROR]").alias("key"), F.lit(config.ERROR).alias("kind"), F.coalesce(F.when(told != "", told), F.lit("Error de extracción no especificado.")).alias("detail"))


def places(source: DataFrame) -> Column:
    """Where a record is: its location if the source has one, else its number."""
    return F.col("ubicacion") if "ubicacion" in source.columns else F.concat(F.lit("fila="), F.col("seq").cast("string"))


def _repeated(source: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """What duplicates() says without its detail, with each record's level_text, and (key, told) with the detail of each key.

    Groups are counted and compared by spellings; records are read to find their spelling's group alone.
    """
    spelled = saved(spellings(valid(source)))
    groups = spelled.groupBy("normalised").agg(F.sum("n").alias("n"), F.countDistinct(F.when(F.col("level") != "", F.col("level"))).alias("levels"), F.min("seq").alias("first"))
    groups = saved(groups.where("n > 1"))
    key = F.concat(F.lit(f"[DUP-{name}] "), "normalised").alias("key")
    titles = spelled.select("normalised", "title").distinct()
    pairs = titles.join(groups.select("normalised"), "normalised").join(titles.select("normalised", F.col("title").alias("other")), "normalised").where("title < other")
    least = pairs.withColumn("ratio", similarity.indel_ratio("title", "other")).groupBy("normalised").agg(F.min("ratio").alias("ratio"))
    of_spelling = saved(spelled.drop("seq", "n").join(groups.join(least, "normalised", "left"), "normalised"))
    records = valid(source).select("seq", F.col("puesto_original").alias("_title"), F.col("nivel_original").alias("_level"), places(source).alias("place"))
    found = records.join(of_spelling, (F.col("_title") == F.col("title")) & F.col("_level").eqNullSafe(F.col("level_text")))
    listed = found.groupBy("normalised").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "place"))), lambda p: p["place"]), "; ").alias("places"))
    told = listed.select(key, F.concat(F.lit("Puesto duplicado "), F.col("n").cast("string"), F.lit(f" veces dentro de {name}. Ubicaciones: "), "places").alias("told"))
    kind = F.when(F.col("levels") > 1, config.DUPLICATE_LEVEL).otherwise(config.DUPLICATE)
    return found.select(F.lit(name).alias("source"), "seq", key, "n", kind.alias("kind"), F.bround(F.coalesce("ratio", F.lit(100.0)), 1).alias("confidence"), "first", "title", "normalised", "level", "level_text"), told


def duplicates(source: DataFrame, name: str) -> DataFrame:
    """A row for each record whose normalised title its source repeats: group's size, kind, detail with all places, confidence, and the group's first record.

    The confidence is the least ratio between two spellings of the title (100 for one); spellings are few
    where records are many, and only they are paired.
    """
    found, told = _repeated(source, name)
    return found.join(told, "key").select("source", "seq", "key", "n", "kind", F.col("told").alias("detail"), "confidence", "first")


def _prefixed(records: DataFrame, name: str) -> DataFrame:
    return records.select(F.col("key").alias(f"{name}_key"), F.struct("seq", "title", "normalised", "level", "level_text").alias(name))


def three_way(excel: DataFrame, word: DataFrame | None, chart: DataFrame) -> DataFrame:
    """One row per reconciled key: structs excel, word and organigrama (null where absent) and the pairs' ranks.

    The reference is matched with either source; what is left of the documents is matched with what is
    left of the chart.  Without documents (word None) their branch isn't planned.
    """
    e, o = representatives(valid(excel)), representatives(valid(chart))
    w = representatives(valid(word)) if word is not None else None
    to_o = match(e, o)
    rows = _prefixed(e, "excel").join(to_o.select(F.col("o_key").alias("excel_key"), F.col("d_key").alias("organigrama_key"), F.col("level").alias("o_level"), F.col("score").alias("o_score"), F.col("reason").alias("o_reason")), "excel_key", "left")
    rows = rows.join(_prefixed(o, "organigrama"), "organigrama_key", "left")
    left_o = o.join(to_o.select(F.col("d_key").alias("key")), "key", "left_anti")
    if w is None:
        only = _prefixed(left_o, "organigrama").withColumn("section", F.lit(3))
        rows = rows.withColumn("section", F.lit(1)).unionByName(only, allowMissingColumns=True)
        kind = rows.schema["excel"].dataType
        rows = rows.withColumns({"word": F.lit(None).cast(kind), "w_level": F.lit(None).cast("string"), "w_score": F.lit(None).cast("double"), "w_reason": F.lit(None).cast("string")})
    else:
        to_w = match(e, w)
        rows = rows.join(to_w.select(F.col("o_key").alias("excel_key"), F.col("d_key").alias("word_key"), F.col("level").alias("w_level"), F.col("score").alias("w_score"), F.col("reason").alias("w_reason")), "excel_key", "left")
        rows = rows.join(_prefixed(w, "word"), "word_key", "left").withColumn("section", F.lit(1))
        left_w = w.join(to_w.select(F.col("d_key").alias("key")), "key", "left_anti")
        rest = match(left_w, left_o)
        more = _prefixed(left_w, "word").join(rest.select(F.col("o_key").alias("word_key"), F.col("d_key").alias("organigrama_key"), F.col("level").alias("o_level"), F.col("score").alias("o_score"), F.col("reason").alias("o_reason")), "word_key", "left")
        more = more.join(_prefixed(o, "organigrama"), "organigrama_key", "left").withColumn("section", F.lit(2))
        only = _prefixed(left_o.join(rest.select(F.col("d_key").alias("key")), "key", "left_anti"), "organigrama").withColumn("section", F.lit(3))
        rows = rows.unionByName(more, allowMissingColumns=True).unionByName(only, allowMissingColumns=True)
    base_o = F.when(F.col("excel").isNotNull(), F.col("excel")).otherwise(F.col("word"))
    rank_o = name_level(F.col("o_level"), base_o["title"], F.col("organigrama.title"), base_o["normalised"], F.col("organigrama.normalised"))
    rank_w = name_level(F.col("w_level"), F.col("excel.title"), F.col("word.title"), F.col("excel.normalised"), F.col("word.normalised"))
    key = F.coalesce(F.col("excel.normalised"), F.col("word.normalised"), F.col("organigrama.normalised"))
    return rows.select("section", F.coalesce("excel.seq", "word.seq", "organigrama.seq").alias("seq"), key.alias("key"), "excel", "word", "organigrama", rank_w.alias("rank_w"), rank_o.alias("rank_o"), "w_score", "o_score", "w_reason", "o_reason")


def _listed(present: list[str], value: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[value[s] for s in present]))


def classify(rows: DataFrame, with_word: bool = True) -> DataFrame:
    """rows of three_way with place, kind, detail, name_level, method, confidence, canonical, equivalence and the warnings.

    Doubtful and possible name matches come first, then missing and extra titles; differing levels
    override missing ones but not doubt.
    """
    rank = F.coalesce(F.greatest("rank_w", "rank_o"), F.when(F.col("excel").isNotNull(), 0).otherwise(1))
    scores = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.col(c)) for c in ("w_score", "o_score")]))
    reason = F.array_join(F.filter(F.array(F.coalesce("w_reason", F.lit("")), F.coalesce("o_reason", F.lit(""))), lambda x: x != ""), " ")
    base = F.when(F.col("excel").isNotNull(), F.col("excel")).otherwise(F.col("word"))["normalised"]
    note = lambda other: F.when(F.col(other).isNotNull() & base.isNotNull(), text.equivalence_note(base, F.col(f"{other}.normalised")))
    of_word = F.when(F.col("excel").isNotNull(), note("word"))
    out = results(rows, rank, F.coalesce(F.array_min(scores), F.lit(100.0)), reason, with_word)
    return out.withColumns({"equivalence": F.coalesce(F.when(of_word != "", of_word), note("organigrama"), F.lit("")), "canonical": text.comparison_key(F.col("key")), "place": order_of(2, F.col("section"), F.lit(0), F.col("seq"))})


def results(rows: DataFrame, rank: Column, base: Column, reason: Column, with_word: bool) -> DataFrame:
    """rows with kind, detail, name_level, method, confidence, catalogue_warning and format_warning.

    rows has the structs excel, word and organigrama, null where absent; rank is the level of name
    comparison, base the confidence before the titles are compared letter by letter, and reason what is said of doubtful names.
    """
    used = SOURCES if with_word else ["excel", "organigrama"]
    order = [s for s in PRESENT if s in used]
    there = {s: F.col(s).isNotNull() for s in used}
    n_present = sum((there[s].cast("int") for s in used), F.lit(0))
    absent = F.concat_ws(", ", *[F.when(~there[s], NAMES[s]) for s in used])
    present = F.concat_ws(", ", *[F.when(there[s], NAMES[s]) for s in order])
    level = {s: F.when(there[s], F.coalesce(F.col(f"{s}.level"), F.lit(""))) for s in used}
    known = F.array_distinct(F.filter(_listed(used, level), lambda x: x != ""))
    n_blank = F.size(F.filter(_listed(used, level), lambda x: x == ""))
    missing = n_present < len(used)
    first = F.when(rank == 4, config.REVISE).when(rank == 3, config.POSSIBLE).when(~there["excel"], config.EXTRA).when(missing, config.MISSING).otherwise(config.OK)
    both = (n_present >= 2) & (rank < 3)
    kind = (
        F.when(both & (F.size(known) > 1), config.LEVEL_DIFFERS)
        .when(both & (n_blank > 0) & (first == config.OK), config.LEVEL_MISSING)
        .when((first == config.OK) & (rank == 1), config.NORMALISED)
        .when((first == config.OK) & (rank == 2), config.EQUIVALENT)
        .otherwise(first)
    )
    where = F.when(missing, F.concat(F.lit(" (No se encontró en: "), absent, F.lit(".)"))).otherwise("")
    shown = F.concat_ws(", ", *[F.when(there[s], F.concat(F.lit(f"{NAMES[s]}="), F.when(level[s] == "", "N/D").otherwise(level[s]))) for s in order])
    told = lambda text, other: F.when(text != "", text).otherwise(other)
    detail = (
        F.when(kind == config.REVISE, F.concat(told(reason, "Similitud de nombre no concluyente entre fuentes."), where))
        .when(kind == config.POSSIBLE, F.concat(told(reason, "Coincidencia de nombre por similitud alta (no exacta)."), where))
        .when(kind == config.LEVEL_DIFFERS, F.concat(F.lit("Nivel distinto entre fuentes ("), shown, F.lit(")."), where))
        .when(kind == config.LEVEL_MISSING, F.concat(F.lit("Nivel no especificado o no reconocido en: "), F.concat_ws(", ", *[F.when(there[s] & (level[s] == ""), NAMES[s]) for s in order]), F.lit(".")))
        .when(kind == config.NORMALISED, "Mismo puesto y nivel; difieren en formato de escritura (mayúsculas/acentos/espacios).")
        .when(kind == config.EQUIVALENT, "Mismo puesto mediante equivalencia institucional (abreviatura reconocida).")
        .when(kind == config.EXTRA, F.concat(F.lit("Puesto no encontrado en Excel (fuente de referencia). Presente en: "), present, F.lit(".")))
        .when(kind == config.MISSING, F.concat(F.lit("Falta en: "), absent, F.lit(".")))
        .otherwise("Presente en todas las fuentes analizadas.")
    )
    title = {s: F.col(f"{s}.title") for s in used}
    ratios = F.array_compact(F.array(*[similarity.indel_ratio(title[a], title[b]) for i, a in enumerate(used) for b in used[i + 1 :]]))
    confidence = F.when(n_present < 2, 0.0).otherwise(F.bround(F.least(base, F.array_min(ratios)), 1))
    said = lambda s, message: F.concat(F.lit(f"{NAMES[s]}: "), message)
    of_level = {s: catalogue.warning(F.col(f"{s}.normalised"), level[s]) for s in used}
    of_word = {s: text.unknown_abbreviation(title[s]) for s in used}
    warned = F.concat_ws(" ", *[said(s, m) for s in order for m in (of_level[s], F.when(there[s], of_word[s]))])
    shouted = F.concat_ws(" ", *[F.when(text.upper_case_warning(title[s]), f"{NAMES[s]}: el puesto debe escribirse completamente en mayúsculas.") for s in order])
    return rows.withColumns({"kind": kind, "detail": detail, "name_level": level_name(rank), "method": method_name(rank), "confidence": confidence, "catalogue_warning": warned, "format_warning": shouted})


def order_of(block: int, part: Column | int, key: Column, seq: Column) -> Column:
    """place, by which results are sorted: block, part of it, a key (null last), record."""
    part = F.lit(part) if isinstance(part, int) else part
    return F.struct(F.lit(block).alias("block"), part.cast("int").alias("part"), key.isNull().alias("open"), key.cast("long").alias("key"), seq.cast("long").alias("seq"))


SECTIONED = ["place", "section", "seq", "key", "excel", "word", "organigrama", "kind", "detail", "name_level", "method", "confidence", "canonical", "equivalence", "catalogue_warning", "format_warning"]


def report_sections(sources: dict[str, DataFrame]) -> DataFrame:
    """All results: errors (-2), duplicates (-1), then matches (1), rest of documents (2) and of the chart (3), in the order of place.

    Errors follow by source and record, duplicates by source, group's first record and record, the others by record.  sources has excel and organigrama, and word unless documents take no part.
    """
    return with_places(*short_sections(sources))


def with_places(results: DataFrame, told: DataFrame) -> DataFrame:
    """results of short_sections with the details of duplicates.

    A row of a group lists all places of the group, so details grow with the square of a group; they are joined last, once results are dealt
    and ordered, and what doesn't ask for them doesn't make them.
    """
    repeated = F.col("section") == -1
    listed = results.where(repeated).join(told, "key").withColumn("detail", F.col("told"))
    return results.where(~repeated).unionByName(listed.select(*results.columns))


def short_sections(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """report_sections with null details of duplicates, and (key, told) with these details."""
    with_word = "word" in sources
    matched = classify(three_way(sources["excel"], sources.get("word"), sources["organigrama"]), with_word)
    zero = F.lit(0)
    out, details = matched.select(*SECTIONED), []
    kind = matched.schema["excel"].dataType
    for name in [s for s in PRESENT if s in sources]:
        source = sources[name]
        record = source.where(~is_valid(source)).select("seq", F.struct("seq", F.col("puesto_original").alias("title"), text.normalise_title(F.col("puesto_original")).alias("normalised"), text.normalise_level(F.col("nivel_original")).alias("level"), F.col("nivel_original").alias("level_text")).cast(kind).alias(name))
        wrong = errors(source, NAMES[name]).withColumns({"confidence": F.lit(100.0), "place": order_of(0, PRESENT.index(name), zero, F.col("seq"))}).join(record, "seq")
        repeated, told = _repeated(source, NAMES[name])
        details.append(told)
        repeated = repeated.withColumns({"detail": F.lit(None).cast("string"), "place": order_of(1, SOURCES.index(name), F.col("first"), F.col("seq")), name: F.struct("seq", "title", "normalised", "level", "level_text").cast(kind)})
        for section, found in ((-2, wrong), (-1, repeated)):
            rows = found.withColumns({"section": F.lit(section), "name_level": level_name(F.lit(0)), "method": F.lit("—"), "canonical": F.lit(""), "equivalence": F.lit(""), "catalogue_warning": F.lit("")})
            shouted = F.when(text.upper_case_warning(F.col(f"{name}.title")) & (F.col("section") == -1), f"{NAMES[name]}: el puesto debe escribirse completamente en mayúsculas.").otherwise("")
            rows = rows.withColumn("format_warning", shouted)
            for other in SOURCES:
                if other != name:
                    rows = rows.withColumn(other, F.lit(None).cast(kind))
            out = out.unionByName(rows.select(*SECTIONED))
    return out, reduce(lambda a, b: a.unionByName(b), details)


def by_kind(results: DataFrame) -> DataFrame:
    """(kind, n), most frequent first."""
    return results.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "kind")
