"""Comparison by ID: each row of the reference names the place that it has in the other sources.

An ID is never deduced from a name nor renumbered.  A source whose places can be relied on is read at
the place of the ID; in another a name that occurs once is compared, without a place, and no occurrence
is used twice.  What no row used comes last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo import config
from cotejo.functions import similarity, text
from cotejo.operators.reconcile import NAMES, errors, order_of, results, valid
from cotejo.operators.sequence import with_position
from cotejo.plans.saved import saved

# Notes in this module are fixed values, in the words that users know.
RECORD = ["seq", "title", "normalised", "level", "level_text", "key", "boss", "boss_key"]
#: Order states from the one that tells most about a row to the one that tells least.
ORDER = [config.UNVERIFIABLE, config.AMBIGUOUS, config.NOT_FOUND, config.MOVED, config.OTHER_BOSS]
COLUMNS = ["place", "section", "seq", "key", "excel", "word", "organigrama", "kind", "detail", "name_level", "method", "confidence", "equivalence", "catalogue_warning", "format_warning"]
STATES = ["id_excel", "position_word", "position_organigrama", "order_word", "order_organigrama", "boss_state", "order_state", "order_detail", "homologation", "similarity"]


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


#: Spellings that are given to all tasks; more are joined by shuffle.
SPELLINGS = 1 << 17


def _spelled(sources: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(text, normalised, key) of the sources' titles and bosses and (text, level) of their levels, saved.

    Records are many where spellings are few, and the functions of texts are dear, so they are made once for each spelling.
    """
    def distinct(columns: list[str]) -> DataFrame:
        told = [df.select(F.col(c).cast("string").alias("text")).distinct() for df in sources for c in columns if c in df.columns]
        return saved(reduce(lambda a, b: a.union(b), told).where("text IS NOT NULL").distinct())

    titles = saved(distinct(["puesto_original", "jefe_inmediato"]).select("text", text.normalise_title(F.col("text")).alias("normalised"), text.comparison_key(F.col("text")).alias("key")))
    levels = saved(distinct(["nivel_original"]).select("text", text.normalise_level(F.col("text")).alias("level")))
    hinted = lambda df: F.broadcast(df) if df.count() <= SPELLINGS else df
    return hinted(titles), hinted(levels)


def _records(source: DataFrame, titles: DataFrame, levels: DataFrame) -> DataFrame:
    """Valid records of a source with their place among them, compared forms (of _spelled) and whether their boss is verified."""
    own = valid(source).select("seq", F.col("puesto_original").alias("title"), F.col("nivel_original").alias("level_text"), _column(source, "jefe_inmediato", "string").alias("boss"), F.coalesce(_column(source, "jerarquia_verificada", "boolean"), F.lit(False)).alias("verified"))
    own = own.join(titles.withColumnRenamed("text", "title"), "title").join(titles.select(F.col("text").alias("boss"), F.col("key").alias("boss_key")), "boss", "left").join(levels.withColumnRenamed("text", "level_text"), "level_text", "left")
    return saved(with_position(own.select("seq", "title", "normalised", F.coalesce("level", F.lit("")).alias("level"), "level_text", "key", "boss", F.coalesce("boss_key", F.lit("")).alias("boss_key"), "verified")))


def _reliable(source: DataFrame, records: DataFrame, chart: bool) -> bool:
    """Whether there are records, all valid, and in a chart all with a verified boss, no error of order, and read at their own place."""
    n = source.count()
    if n == 0 or records.count() != n:
        return False
    if not chart:
        return True
    placed = with_position(source.select("seq", *(_column(source, c, k).alias(c) for c, k in (("jerarquia_verificada", "boolean"), ("error_orden", "string"), ("posicion_lectura", "long")))))
    sound = F.coalesce("jerarquia_verificada", F.lit(False)) & (F.coalesce("error_orden", F.lit("")) == "") & F.coalesce(F.col("posicion_lectura") == F.col("position"), F.lit(False))
    return placed.where(~sound).isEmpty()


def _counted(records: DataFrame, by: list[str], name: str) -> DataFrame:
    return records.groupBy(*by).agg(F.struct(F.count("*").alias("n"), F.min("position").alias("at")).alias(name))


def _group(of_boss: Column, of_level: Column) -> Column:
    """What records that a row can mean have in common: their name, and their boss and level where they count."""
    return F.struct(of_boss.alias("of_boss"), of_level.alias("of_level"), F.col("key"), F.when(of_boss, F.col("boss_key")).otherwise("").alias("boss_key"), F.when(of_level, F.col("level")).otherwise("").alias("level"))


def _found(rows: DataFrame, records: DataFrame, chart: bool) -> DataFrame:
    """rows (of the reference) with n, the number of candidates, at, the first one's place, and group: the records of their name, in a chart of their verified boss too
    where they have one, and of their level where several are and one has it."""
    out = rows.join(_counted(records, ["key"], "_all"), "key", "left").join(_counted(records, ["key", "level"], "_level"), ["key", "level"], "left")
    names, levels, of_boss = F.col("_all"), F.col("_level"), F.lit(False)
    if chart:
        known = records.where("verified")
        out = out.join(_counted(known, ["key", "boss_key"], "_boss"), ["key", "boss_key"], "left").join(_counted(known, ["key", "boss_key", "level"], "_boss_level"), ["key", "boss_key", "level"], "left")
        of_boss = F.coalesce(F.col("boss"), F.lit("")) != ""
        names, levels = F.when(of_boss, F.col("_boss")).otherwise(names), F.when(of_boss, F.col("_boss_level")).otherwise(levels)
    many = F.coalesce(names["n"] > 1, F.lit(False)) & (F.col("level") != "") & levels.isNotNull()
    meant = F.when(many, levels).otherwise(names)
    out = out.withColumns({"n": F.coalesce(meant["n"], F.lit(0).cast("long")), "at": meant["at"], "group": _group(of_boss, many), "n_like": F.coalesce(F.col("_level.n"), F.lit(0).cast("long"))})
    return out.drop("_all", "_level", "_boss", "_boss_level")


def _listed(unsure: DataFrame, records: DataFrame) -> DataFrame:
    """(seq, told) of unsure rows (seq, group, note, after): the note with the places of the group's records.

    Each row lists all of them, so these notes grow with the square of a group; they are made for these rows alone and joined last.
    """
    groups = F.explode(F.array_compact(F.array(*[F.when(F.lit(True) if not boss else F.col("verified"), _group(F.lit(boss), F.lit(level))) for boss in (False, True) for level in (False, True)])))
    own = records.select("position", groups.alias("group")).join(unsure.select("group").distinct(), "group", "left_semi")
    lists = own.groupBy("group").agg(F.array_join(F.transform(F.sort_array(F.collect_list("position")), lambda p: p.cast("string")), ", ").alias("listed"))
    return unsure.join(lists, "group").select("seq", F.concat("note", "listed", "after").alias("told"))


def _review(rows: DataFrame, records: DataFrame, source: str, reliable: bool) -> DataFrame:
    """(seq, record, position, state, note, group, after) of the reference's rows in a source; where group isn't null, the places of its records belong between note and after (_listed)."""
    name, chart = NAMES[source], source == "organigrama"
    found = _found(rows, records, chart)
    record = F.struct(*RECORD)
    if not reliable:
        placed = found.withColumn("at", F.when(F.col("n") == 1, F.col("at"))).join(records.select(F.col("position").alias("at"), record.alias("record")), "at", "left")
        order = F.struct(F.col("id_excel"), F.col("seq"))
        first = placed.where("at IS NOT NULL").groupBy("at").agg(F.min(order).alias("first"))  # the row that uses an occurrence
        placed = placed.join(first, "at", "left")
        again = F.col("at").isNotNull() & (F.col("first.seq") != F.col("seq"))
        note = F.when(again, f"{name}: nombre repetido sin posición verificable; no se reutiliza otra aparición.").otherwise(f"{name}: orden no verificable; revisar extracción o conexiones.")
        return placed.select("seq", F.when(~again, F.col("record")).alias("record"), F.lit(None).cast("long").alias("position"), F.lit(config.UNVERIFIABLE).alias("state"), note.alias("note"), F.lit(None).cast(found.schema["group"].dataType).alias("group"), F.lit(None).cast("string").alias("after"))
    actual = records.select(F.col("position").alias("id_excel"), record.alias("record"))
    placed = found.join(actual, "id_excel", "left")
    there, expected = F.col("record").isNotNull(), F.col("id_excel").cast("string")
    same_name = there & (F.col("record.key") == F.col("key"))
    asked = F.coalesce(F.col("boss"), F.lit("")) != ""
    same_boss = ~asked | (F.coalesce("record.boss_key", F.lit("")) == F.col("boss_key")) if chart else F.lit(True)
    lost_boss = F.startswith(F.coalesce("boss", F.lit("")), F.lit(config.NO_BOSS_ROW)) if chart else F.lit(False)
    n = F.col("n")
    state = (
        F.when(lost_boss, config.UNVERIFIABLE).when(same_name & same_boss, config.SAME).when(n == 1, config.MOVED).when(n > 1, config.AMBIGUOUS).when(same_name, config.OTHER_BOSS).otherwise(config.NOT_FOUND)
    )
    read = F.when(there, F.concat(F.lit(" En la posición esperada se leyó «"), F.col("record.title"), F.lit("»."))).otherwise("")
    repeated = F.when(F.col("n_like") > 1, " Nombre/nivel repetidos: coincide por posición; Word no permite verificar el jefe inmediato.").otherwise("") if source == "word" else F.lit("")
    note = (
        F.when(lost_boss, "Organigrama: corregir la referencia de jefe inmediato del Excel.")
        .when(state == config.SAME, F.concat(F.lit(f"{name}: coincide en posición "), expected, F.lit("."), repeated))
        .when(state == config.MOVED, F.concat(F.lit(f"Encontrado en diferente posición; realizar ajuste. {name}: posición "), F.col("at").cast("string"), F.lit("; esperada "), expected, F.lit(" según Excel."), read))
        .when(state == config.AMBIGUOUS, f"{name}: coincidencia ambigua en posiciones ")
        .when(state == config.OTHER_BOSS, F.concat(F.lit(f"{name}: el nombre coincide en posición "), expected, F.lit(", pero pertenece a otro jefe inmediato."), read))
        .otherwise(F.concat(F.lit(f"{name}: puesto esperado no encontrado; revisar la posición "), expected, F.lit("."), read))
    )
    unsure = state == config.AMBIGUOUS
    return placed.select(
        "seq", "record", F.when(there, F.col("id_excel")).alias("position"), state.alias("state"), note.alias("note"),
        F.when(unsure, F.col("group")).alias("group"), F.when(unsure, F.concat(F.lit("; esperada "), expected, F.lit("."), read)).alias("after"),
    )


def _homologation(sources: list[str]) -> tuple[Column, Column]:
    """State and similarity of a row's names; in a comparison by ID equal names of several rows are occurrences, no duplicates."""
    pairs = [(a, b) for a, b in (("excel", "word"), ("excel", "organigrama"), ("word", "organigrama")) if a in sources and b in sources]
    state, least = F.lit("Coinciden"), []
    all_there = reduce(lambda a, b: a & b, [F.col(s).isNotNull() for s in sources])
    for a, b in pairs:
        equal = F.col(f"{a}.key") == F.col(f"{b}.key")
        state = F.when(~F.coalesce(equal, F.lit(True)), "No coinciden").otherwise(state)
        least.append(F.when(equal, 100.0).otherwise(F.least(F.lit(99.9), F.bround(similarity.indel_ratio(F.col(f"{a}.key"), F.col(f"{b}.key")), 1))))
    return F.when(all_there, state).otherwise("No comparable"), F.when(all_there, F.array_min(F.array(*least)))


def compare_by_id(excel: DataFrame, word: DataFrame | None, chart: DataFrame) -> DataFrame:
    """COLUMNS and STATES of each row of the reference (section 1), each record that none used (2: chart, 3: documents) and each error (-2), in the order of place.

    Rows of the reference and its errors come first, in the order of their IDs (those without one last), then each source's by record.

    All have seq, puesto_original and nivel_original, and may have error and jefe_inmediato; the
    reference has id_excel (long) and may have error_id, the chart may have jerarquia_verificada,
    error_orden and posicion_lectura.  Without documents (None) they take no part.  The places of a name are listed in its
    rows' notes, so a name that very many records and rows have makes long notes.
    """
    sources = {"organigrama": chart} | ({"word": word} if word is not None else {})
    with_word = word is not None
    used = ["excel", *(s for s in ("word", "organigrama") if s in sources)]
    spelled = _spelled([excel, *sources.values()])
    records = {s: _records(df, *spelled) for s, df in sources.items()}
    reliable = {s: _reliable(sources[s], records[s], s == "organigrama") for s in sources}
    ids = excel.where("id_excel IS NOT NULL").groupBy("id_excel").agg(F.count("*").alias("n_id"))
    known = F.coalesce(_column(excel, "error_id", "string"), F.lit(""))
    bad = F.when(known != "", known).when(F.coalesce(F.col("id_excel") <= 0, F.lit(True)), "ID vacío o inválido.").when(F.col("n_id") > 1, F.concat(F.lit("ID repetido: "), F.col("id_excel").cast("string"), F.lit("."))).otherwise("")
    own = saved(excel.join(ids, "id_excel", "left").select("seq", "id_excel", bad.alias("bad")))
    rows = saved(_records(excel, *spelled).drop("position", "verified").join(own, "seq"))
    out = rows.select("id_excel", "bad", F.struct(*RECORD).alias("excel"), *RECORD)
    for s in sources:
        reviewed = _review(rows.where("bad = ''"), records[s], s, reliable[s]).select("seq", F.col("record").alias(s), F.col("position").alias(f"position_{s}"), F.col("state").alias(f"_{s}_state"), F.col("note").alias(f"_{s}_note"), F.col("group").alias(f"_{s}_group"), F.col("after").alias(f"_{s}_after"))
        out = out.join(reviewed, "seq", "left")
    if not with_word:
        out = out.withColumns({"word": F.lit(None).cast(out.schema["excel"].dataType), "position_word": F.lit(None).cast("long"), "_word_state": F.lit(None).cast("string"), "_word_note": F.lit(None).cast("string")})
    for s, df in (("excel", rows), ("organigrama", records["organigrama"])):  # how many have the boss's name
        counts = df.groupBy(F.col("key").alias("boss_key")).agg(F.count("*").alias(f"_{s}_named"))
        out = out.join(counts, "boss_key", "left")
    out = saved(out)

    there = lambda s: F.col(s).isNotNull()
    same = reduce(lambda a, b: a & b, [~there(s) | (F.col(f"{s}.key") == F.col("key")) for s in sources])
    equal = reduce(lambda a, b: a & b, [~there(s) | (F.col(f"{s}.title") == F.col("title")) for s in sources])
    rank = F.when(equal, 0).when(same, 2).otherwise(4)
    # saved, since what is said of titles and of bosses and order in one step makes code that is too large to be compiled to machine code
    judged = saved(results(out, rank, F.when(same, 100.0).otherwise(0.0), F.lit("Puesto diferente en la posición esperada por el ID de Excel."), with_word))

    boss = F.coalesce("boss", F.lit(""))
    lost_boss = F.startswith(boss, F.lit(config.NO_BOSS_ROW))
    verified = records["organigrama"].select("seq", "verified").withColumnRenamed("seq", "_chart_seq")
    judged = judged.join(verified, F.col("organigrama.seq") == F.col("_chart_seq"), "left")
    boss_state = (
        F.when(~F.coalesce("verified", F.lit(False)), config.UNVERIFIABLE)
        .when(boss == "", config.NO_BOSS)
        .when(lost_boss, config.UNVERIFIABLE)
        .when((F.coalesce("_excel_named", F.lit(0)) > 1) | (F.coalesce("_organigrama_named", F.lit(0)) > 1), config.AMBIGUOUS_BOSS)
        .when(F.col("boss_key") == F.col("organigrama.boss_key"), config.BOSS_AGREES)
        .otherwise(config.OTHER_BOSS)
    )
    states = F.array(*[F.coalesce(f"_{s}_state", F.lit("")) for s in ("organigrama", "word")])
    worst = F.lit(config.SAME)
    for s in reversed(ORDER):
        worst = F.when(F.array_contains(states, s), s).otherwise(worst)
    told = F.when(F.col("bad") != "", config.CHECK_ID).otherwise(worst)
    told = F.when(lost_boss, config.UNVERIFIABLE).otherwise(told)
    order_state = F.when(boss_state.isin(config.AMBIGUOUS_BOSS, config.OTHER_BOSS) & (told == config.SAME), boss_state).otherwise(told)
    levels = [
        F.when(there(s) & (F.coalesce(f"{s}.level", F.lit("")) != F.col("level")), F.concat(F.lit("Nivel: Excel="), _shown("level_text"), F.lit(f"; {NAMES[s]}="), _shown(f"{s}.level_text"), F.lit(".")))
        for s in ("word", "organigrama")
        if s in sources
    ]
    disorder = F.lit(None).cast("string")
    if not reliable["organigrama"] and "error_orden" in chart.columns:
        said = chart.where("error_orden <> ''").groupBy("error_orden").agg(F.min("seq").alias("seq"))
        disorder = said.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "error_orden"))), lambda x: x["error_orden"]), " ").alias("d")).scalar()
        disorder = F.when(~there("organigrama") & (disorder != ""), disorder)
    boss_note = F.when(
        boss_state.isin(config.AMBIGUOUS_BOSS, config.OTHER_BOSS),
        F.concat(F.lit("Jefe inmediato: "), boss_state, F.lit(". Excel: «"), boss, F.lit("»; organigrama: «"), F.coalesce("organigrama.boss", F.when(there("organigrama"), F.lit("")).otherwise("—")), F.lit("».")),
    )
    notes = [F.when(F.col("bad") != "", F.col("bad")), F.when(lost_boss, F.concat(F.lit("Excel: "), boss, F.lit("; corregir la referencia del jefe inmediato."))), boss_note, *levels, disorder]
    unsure = reduce(lambda a, b: a | b, [F.col("bad") != "", *[~there(s) for s in sources if not reliable[s]]])
    odd = (F.col("bad") != "") | (order_state != config.SAME)
    kind = F.when(unsure | odd & F.col("kind").isin(config.OK, config.NORMALISED, config.EQUIVALENT), config.REVISE).otherwise(F.col("kind"))
    detail = F.when(unsure, "No se puede asignar una aparición con certeza; revisar el detalle de orden.").otherwise(F.col("detail"))
    pair_notes = [F.when(there(s), text.equivalence_note(F.col("normalised"), F.col(f"{s}.normalised"))) for s in ("word", "organigrama") if s in sources]
    homologation, alike = _homologation(used)
    main = saved(
        judged.select(
            order_of(2, 1, F.col("id_excel"), F.col("seq")).alias("place"), F.lit(1).alias("section"), "seq", F.col("normalised").alias("key"), "excel", "word", "organigrama", kind.alias("kind"), detail.alias("detail"), "name_level", "method", "confidence",
            F.concat_ws(" ", *pair_notes).alias("equivalence"), "catalogue_warning", "format_warning", "id_excel", "position_word", "position_organigrama",
            F.coalesce("_word_state", F.lit(config.UNVERIFIABLE)).alias("order_word"), F.coalesce("_organigrama_state", F.lit(config.UNVERIFIABLE)).alias("order_organigrama"),
            boss_state.alias("boss_state"), order_state.alias("order_state"), F.concat_ws(" ", *notes).alias("order_detail"), homologation.alias("homologation"), alike.alias("similarity"), "_organigrama_note", "_word_note",
        )
    )
    full = main
    for s in sources:
        unsure = out.where(F.col(f"_{s}_group").isNotNull()).select("seq", F.col(f"_{s}_group").alias("group"), F.col(f"_{s}_note").alias("note"), F.col(f"_{s}_after").alias("after"))
        full = full.join(_listed(unsure, records[s]).withColumnRenamed("told", f"_{s}_listed"), "seq", "left").withColumn(f"_{s}_note", F.coalesce(f"_{s}_listed", f"_{s}_note"))
    full = full.withColumn("order_detail", F.concat_ws(" ", "_organigrama_note", "_word_note", F.nullif("order_detail", F.lit("")))).select(*COLUMNS, *STATES)
    open_ids = not own.where("bad <> ''").isEmpty()
    parts = [full]
    for section, s in ((2, "organigrama"), (3, "word")):
        if s in sources:
            parts.append(_unused(records[s], main, s, section, open_ids or not reliable[s], reliable[s], with_word))
    kinds = {c: main.schema[c].dataType for c in (*COLUMNS, *STATES)}
    for part, (s, df) in enumerate({"excel": excel, **sources}.items(), 1):
        wrong = errors(df, NAMES[s]).drop("source")
        key = F.lit(0)
        if s == "excel":
            wrong, key = wrong.join(excel.select("seq", "id_excel"), "seq"), F.col("id_excel")
        wrong = wrong.withColumn("place", order_of(2, part, key, F.col("seq"))).drop("id_excel").withColumns({"section": F.lit(-2), "confidence": F.lit(100.0), "name_level": F.lit(config.NAME_LEVELS[0])})
        parts.append(wrong.select(*[F.col(c).cast(kinds[c]).alias(c) if c in wrong.columns else F.lit(None).cast(kinds[c]).alias(c) for c in (*COLUMNS, *STATES)]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _shown(level: str) -> Column:
    return F.when(F.coalesce(level, F.lit("")) == "", "N/D").otherwise(F.col(level))


def _unused(records: DataFrame, main: DataFrame, source: str, section: int, unsure: bool, reliable: bool, with_word: bool) -> DataFrame:
    """Results of the records that no row of the reference used."""
    taken = main.where(F.col(source).isNotNull()).select(F.col(f"{source}.seq").alias("seq")).distinct()
    kind = main.schema["excel"].dataType
    left = records.join(taken, "seq", "left_anti").select("seq", F.col("normalised").alias("key"), "position", F.struct(*RECORD).cast(kind).alias(source))
    left = left.withColumns({s: F.lit(None).cast(kind) for s in ("excel", "word", "organigrama") if s != source})
    left = results(left, F.lit(0), F.lit(0.0), F.lit(""), with_word)
    at = F.col("position") if reliable else F.lit(None).cast("long")
    none = F.lit(None).cast("long")
    return left.select(
        order_of(2, section, F.lit(0), F.col("seq")).alias("place"), F.lit(section).alias("section"), "seq", "key", "excel", "word", "organigrama",
        (F.lit(config.REVISE) if unsure else F.col("kind")).alias("kind"),
        (F.lit("Aparición sin referencia asignada; no se puede confirmar que sea adicional.") if unsure else F.col("detail")).alias("detail"),
        "name_level", "method", "confidence", F.lit("").alias("equivalence"), "catalogue_warning", "format_warning", none.alias("id_excel"),
        (at if source == "word" else none).alias("position_word"), (at if source == "organigrama" else none).alias("position_organigrama"),
        F.lit(config.UNVERIFIABLE).alias("order_word"), F.lit(config.UNVERIFIABLE).alias("order_organigrama"), F.lit(config.UNVERIFIABLE).alias("boss_state"),
        F.lit(config.UNASSIGNED).alias("order_state"), F.lit(f"{NAMES[source]}: aparición sin ID de Excel asignado; revisar puestos adicionales o IDs pendientes.").alias("order_detail"),
        F.lit("No comparable").alias("homologation"), F.lit(None).cast("double").alias("similarity"),
    )
