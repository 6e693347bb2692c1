"""Rows of the report and of its summary, and workbooks of them."""

from __future__ import annotations

import io
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo import config
from cotejo.functions import catalogue, similarity, text
from cotejo.operators.reconcile import NAMES, SOURCES, is_valid, valid, with_places
from cotejo.plans.graphs import global_order
from cotejo.plans.saved import saved
from cotejo.sources import workbook

# The names of the report's columns and metrics in this module are fixed values.
PAIRS = [("excel", "word"), ("excel", "organigrama"), ("word", "organigrama")]


def _keys(results: DataFrame, source: str) -> Column:
    """The comparison key of a source's title: records of a comparison by ID have it, others' is made."""
    return F.col(f"{source}.key") if "key" in results.schema[source].dataType.names else text.comparison_key(F.col(f"{source}.title"))


def homologation(results: DataFrame, sources: dict[str, DataFrame] | None, with_word: bool = True) -> DataFrame:
    """results with compared (map of pair to state), homologation and similarity.

    A title's key is looked up in every source; a key that a source repeats is to be revised (sources None: equal
    names are occurrences, as in a comparison by ID).  The similarity is that of the least similar pair, null unless all pairs are
    comparable, and 100 only where they are equal.
    """
    used = [s for s in SOURCES if with_word or s != "word"]
    out = results
    for name in used:
        out = out.withColumn(f"_{name}_key", F.when(F.col(name).isNotNull() & (F.col("key") != "[ERROR]"), _keys(results, name)))
        if sources is None:
            out = out.withColumn(f"_{name}_n", F.lit(1))
        else:
            titles = valid(sources[name]).groupBy("puesto_original").agg(F.count("*").alias("n"))  # keys are made once for each title
            counts = saved(titles.groupBy(text.comparison_key(F.col("puesto_original")).alias(f"_{name}_key")).agg(F.sum("n").alias(f"_{name}_n")))
            out = out.join(counts, f"_{name}_key", "left")
    pairs = [(a, b) for a, b in PAIRS if a in used and b in used]
    key = lambda s: F.col(f"_{s}_key")
    states, scores = [], []
    for a, b in pairs:
        there = key(a).isNotNull() & key(b).isNotNull()
        repeated = (F.coalesce(F.col(f"_{a}_n"), F.lit(0)) > 1) | (F.coalesce(F.col(f"_{b}_n"), F.lit(0)) > 1)
        states.append(F.when(~there, "No comparable").when(repeated, "Revisar duplicados").when(key(a) == key(b), "Coinciden").otherwise("No coinciden"))
        scores.append(F.when(there & (key(a) == key(b)), 100.0).when(there, F.least(F.lit(99.9), F.bround(similarity.indel_ratio(key(a), key(b)), 1))))
    state = F.array(*states)
    overall = F.lit("Coinciden")
    for s in ("No coinciden", "No comparable", "Revisar duplicados"):
        overall = F.when(F.array_contains(state, s), s).otherwise(overall)
    comparable = ~F.array_contains(state, "No comparable") & ~F.array_contains(state, "Revisar duplicados")
    names = F.array(*[F.lit(f"{NAMES[a]} vs {NAMES[b]}") for a, b in pairs])
    out = out.withColumns({"compared": F.map_from_arrays(names, state), "homologation": overall, "similarity": F.when(comparable, F.array_min(F.array(*scores)))})
    return out.drop(*[f"_{s}_{x}" for s in used for x in ("key", "n")])


def _or(value: Column, other: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", other).otherwise(value)


def _with_names(results: DataFrame, used: list[str]) -> DataFrame:
    """results with what rows say of titles in several columns, made once for each: shown title, key and category of each source's, key and category of the first."""
    out = results.withColumns({f"_{s}_shown": F.col(f"{s}.title") if s == "organigrama" else text.homologate(F.col(f"{s}.title")) for s in used} | {f"_{s}_key": F.when(F.col(s).isNotNull(), _keys(results, s)) for s in used})
    out = out.withColumns({f"_{s}_kind": catalogue.category(F.col(f"_{s}_key")) for s in used})
    first = lambda what: reduce(lambda other, s: F.when(F.col(s).isNotNull(), F.col(f"_{s}_{what}")).otherwise(other), [s for s in reversed(used)], F.lit(None).cast("string"))
    return out.withColumns({"_key": first("key"), "_kind": first("kind")})


def name_differences(used: list[str], by_id: bool) -> Column:
    """What a result's sources say differently of its name; of results that _with_names() went through."""
    order = [s for s in ("excel", "organigrama", "word") if s in used]
    error = F.col("key") == "[ERROR]"
    parts = []
    for s in order:
        lost = F.lit(f"{NAMES[s]}: puesto no encontrado en esta comparación.")
        if by_id and s != "excel":
            pending = (F.col("order_state") == config.CHECK_ID) | (F.col(f"order_{s}") == config.UNVERIFIABLE)
            lost = F.when(pending & (F.col("section") >= 1), f"{NAMES[s]}: aparición sin asignar; consultar el detalle de orden.").otherwise(lost)
        parts.append(F.when(F.col(s).isNull(), lost).when(error, f"{NAMES[s]}: error de extracción; revisar el documento."))
    shown = {s: F.col(f"_{s}_shown") for s in used}
    for a, b in PAIRS:
        if a in used and b in used:
            pair = f"{NAMES[a]} vs {NAMES[b]}"
            state = F.try_element_at("compared", F.lit(pair))
            parts.append(
                F.when(state == "Revisar duplicados", f"{pair}: hay nombres duplicados; no se puede determinar una correspondencia única.").when(
                    state == "No coinciden", F.concat(F.lit(f"{pair}: nombres diferentes: «"), shown[a], F.lit("» / «"), shown[b], F.lit("»."))
                )
            )
    said = F.concat_ws(" ", *parts)
    agreed = F.when(F.col("homologation") == "Coinciden", "Sin diferencias de nombre tras homologación. Los niveles se validan por separado.").otherwise("Comparación de nombres pendiente.")
    return F.when(said != "", said).otherwise(agreed)


def rows(results: DataFrame, with_word: bool = True, numbered: str | None = None) -> DataFrame:
    """The report's 41 columns (33 without documents) of results that homologation() went through, in their order.

    A dash stands for what is absent, N/D for an absent level.  Results of a comparison by ID have its
    columns; others say that there is no ID.  numbered: a column of results that stands before them, by which whoever reads them can order
    them; they aren't ordered then.
    """
    used = [s for s in SOURCES if with_word or s != "word"]
    by_id = "order_state" in results.columns
    there = {s: F.col(s).isNotNull() for s in used}
    first, kind = F.col("_key"), F.col("_kind")
    levels = F.array_join(F.transform(catalogue.levels(kind), lambda n: n.cast("string")), ", ")
    canonical = F.col("canonical") if "canonical" in results.columns else first
    title = {s: F.when(there[s], F.coalesce(f"{s}.title", F.lit(""))).otherwise("—") for s in used}
    level = {s: F.when(there[s], _or(F.col(f"{s}.level_text"), "N/D")).otherwise("—") for s in used}
    state = {s: F.when(there[s], catalogue.level_state(F.col(f"_{s}_kind"), F.col(f"{s}.level"))).otherwise("—") for s in used}
    name = {s: F.when(there[s] & (F.col("key") != "[ERROR]"), F.col(f"_{s}_shown")).otherwise("—") for s in used}
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—")) if by_id else F.lit("—")
    of = lambda c, other: F.col(c) if by_id else F.lit(other)
    boss = lambda s: F.when(there[s], _or(F.col(f"{s}.boss"), "—")).otherwise("—") if by_id else F.lit("—")
    no = config.UNVERIFIABLE
    out = {"Puesto (clave normalizada)": F.col("key"), "Puesto canónico": F.when(canonical != "", canonical).otherwise(F.col("key")), "Tipo de puesto": F.coalesce(catalogue.display(kind), F.lit("")), "Nombre específico": F.coalesce(catalogue.specific_name(first), F.lit("")), "Niveles según catálogo": _or(levels, "—")}
    for s in used:
        out |= {f"{NAMES[s]} - Original": title[s], f"{NAMES[s]} - Nivel": level[s], f"{NAMES[s]} - Estado de nivel": state[s]}
    out |= {
        "Resultado": F.when(F.col("kind") == config.OK, "OK").otherwise("Revisar"),
        "Tipo de inconsistencia": F.col("kind"),
        "Nivel de coincidencia de nombre": F.col("name_level"),
        "Método de coincidencia": _or(F.col("method"), "—"),
        "Confianza (%)": F.col("confidence"),
        "Motivo": F.col("detail"),
        "Equivalencia institucional aplicada": F.coalesce("equivalence", F.lit("")),
        "Advertencia de catálogo (informativa)": F.coalesce("catalogue_warning", F.lit("")),
    }
    out |= {f"{NAMES[s]} - Puesto homologado": name[s] for s in used}
    out |= {f"Homologado: {NAMES[a]} vs {NAMES[b]}": F.coalesce(F.try_element_at("compared", F.lit(f"{NAMES[a]} vs {NAMES[b]}")), F.lit("No comparable")) for a, b in PAIRS if a in used and b in used}
    out |= {"Resultado de homologación": F.col("homologation"), "Detalle de inconsistencia de nombres": name_differences(used, by_id), "Similitud de nombres homologados (%)": F.coalesce(F.col("similarity").cast("string"), F.lit("No comparable"))}
    out |= {"ID esperado - Excel": at("id_excel"), "Jefe inmediato - Excel": boss("excel")}
    if with_word:
        out |= {"Posición leída - Word": at("position_word"), "Orden - Word": of("order_word", no)}
    out |= {
        "Posición leída - Organigrama": at("position_organigrama"),
        "Jefe inmediato - Organigrama": boss("organigrama"),
        "Validación de jefe inmediato": of("boss_state", no),
        "Orden - Organigrama": of("order_organigrama", no),
        "Resultado de orden": of("order_state", no),
        "Detalle de orden": of("order_detail", "Sin ID de referencia en Excel; solo se comparan nombres y niveles."),
    }
    ordered = _with_names(results if numbered else results.orderBy("place"), used)
    return ordered.select(*([F.col(numbered)] if numbered else []), *[c.alias(n) for n, c in out.items()])


def placed_rows(results: DataFrame, with_word: bool = True, told: DataFrame | None = None) -> DataFrame:
    """rows behind Lugar (long), each row's place in the report from 1, in no order.  told: details of duplicates that results lack (see reconcile.with_places)."""
    ordered = global_order(results, ["place"], "Lugar").withColumn("Lugar", F.col("Lugar") + 1)
    return rows(ordered if told is None else with_places(ordered, told), with_word, "Lugar")


def filtered(rows: DataFrame, kinds: list[str] | None = None, open_names: bool = False, open_order: bool = False, search: str = "") -> DataFrame:
    """The report's rows of the kinds (None: all), of open name or order questions only, and whose key holds the searched text, in any case."""
    out = rows if kinds is None else rows.where(F.col("Tipo de inconsistencia").isin(*kinds))
    if open_names:
        out = out.where(F.col("Resultado de homologación") != "Coinciden")
    if open_order:
        out = out.where(F.col("Resultado de orden") != config.SAME)
    return out.where(F.contains(F.lower("Puesto (clave normalizada)"), F.lower(F.lit(search)))) if search else out


def summary(results: DataFrame, with_word: bool = True) -> DataFrame:
    """(metric, value): the 16 counts of the summary (12 without documents), of results that homologation() went through, in one pass."""
    by_id = "order_state" in results.columns
    main = ~F.col("key").startswith("[DUP-") & (F.col("key") != "[ERROR]")
    e, w, o = (F.col(s).isNotNull() for s in ("excel", "word", "organigrama"))
    checked = main & e if by_id else F.lit(False)
    counts = {
        "Total de puestos esperados (Excel)": main & e,
        "Registros revisados por ID de Excel": checked,
        "Registros con diferencias o pendientes de orden": checked & (F.col("order_state") != config.SAME) if by_id else F.lit(False),
        "Nombres coincidentes tras homologación (no valida niveles)": main & (F.col("homologation") == "Coinciden"),
        "Encontrados en Word": main & w,
        "Encontrados en Organigrama": main & o,
        "Coincidencias en las tres fuentes": main & e & w & o,
        "Coincidencias mediante equivalencia institucional (abreviaturas)": main & (F.col("kind") == config.EQUIVALENT),
        "Faltantes reales en Word": main & e & ~w,
        "Faltantes reales en Organigrama": main & e & ~o,
        "Posibles coincidencias (revisar)": main & (F.col("kind") == config.POSSIBLE),
        "Requieren revisión manual (ambiguos)": main & (F.col("kind") == config.REVISE),
        "Puestos adicionales en Word (no están en Excel)": main & w & ~e,
        "Puestos adicionales en Organigrama (no están en Excel)": main & o & ~e,
        "Duplicados detectados": F.col("key").startswith("[DUP-"),
        "Errores de extracción": F.col("key") == "[ERROR]",
    }
    if not with_word:
        counts = {k: c for k, c in counts.items() if "Word" not in k and "tres" not in k}
    one = results.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(counts.values())])
    told = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("metric"), F.col(f"c{i}").alias("value")) for i, n in enumerate(counts)])
    return one.select(F.explode(told).alias("m")).select("m.place", "m.metric", "m.value")


def by_source(results: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """(source, extracted, valid, matched, possible, missing) of each source; results are read once."""
    main = ~F.col("key").startswith("[DUP-") & (F.col("key") != "[ERROR]")
    there = lambda s: main & F.col(s).isNotNull()
    sums = []
    for s in sources:
        sums += [
            F.count_if(there(s) & F.col("kind").isin(config.OK, config.NORMALISED, config.EQUIVALENT)).alias(f"{s}_matched"),
            F.count_if(there(s) & F.col("kind").isin(config.POSSIBLE, config.REVISE)).alias(f"{s}_possible"),
            F.count_if(main & F.col("excel").isNotNull() & F.col(s).isNull()).alias(f"{s}_missing"),
        ]
    one = results.agg(*sums)
    for s, source in sources.items():
        one = one.withColumn(f"{s}_read", source.agg(F.struct(F.count("*").alias("extracted"), F.count_if(is_valid(source)).alias("valid")).alias("c")).scalar())
    told = F.array(*[F.struct(F.lit(NAMES[s]).alias("source"), F.col(f"{s}_read.extracted").alias("extracted"), F.col(f"{s}_read.valid").alias("valid"), *[F.col(f"{s}_{c}").alias(c) for c in ("matched", "possible", "missing")]) for s in sources])
    return one.select(F.explode(told).alias("s")).select("s.*")


# Fills of the report's rows by the type of result; others are white.
COLOURS = {
    config.OK: "C6EFCE",
    config.NORMALISED: "D9E1F2",
    config.EQUIVALENT: "B4C7E7",
    config.POSSIBLE: "FFEB9C",
    config.REVISE: "FFEB9C",
    config.LEVEL_DIFFERS: "FFC7CE",
    config.LEVEL_MISSING: "FFD966",
    config.MISSING: "FFC7CE",
    config.EXTRA: "F4B183",
    config.DUPLICATE: "E2C6F0",
    config.DUPLICATE_LEVEL: "C586DB",
    config.ERROR: "808080",
}
# Lines of the summary sheet.
TITLE, MODE = "Resumen general del análisis", "Modo de análisis: "
MODES = {True: "Excel + Word + Organigrama (completo)", False: "Excel vs Organigrama (Word no participó)"}
WALK = "Revisión por ID y ramas: 2026-10-12. Recorrido superior → rama izquierda completa → siguiente rama."
HEADS = ["Métrica", "Valor"], ["Tipo de inconsistencia", "Cantidad"], ["Fuente", "Extraídos", "Válidos", "Coincidencias", "Posibles coincidencias", "Faltantes"]
BY_SOURCE = "Desglose por fuente"


def summary_lines(results: DataFrame, sources: dict[str, DataFrame], with_word: bool = True) -> list[tuple[str, list]]:
    """(style, values) of the summary sheet's lines: counts, types of results and sources, about forty in all."""
    order = [s for s in SOURCES if s in sources]
    by = {r["source"]: list(r) for r in by_source(results, sources).collect()}
    kinds = results.groupBy("kind").agg(F.count("*").alias("n"), F.min("place").alias("first")).orderBy(F.col("n").desc(), "first").collect()
    return [
        ("title", [TITLE]),
        ("", [MODE + MODES[with_word]]),
        ("", [WALK]),
        ("bold", HEADS[0]),
        *(("", [r["metric"], r["value"]]) for r in summary(results, with_word).orderBy("place").collect()),
        ("", []),
        ("bold", HEADS[1]),
        *(("", [r["kind"], r["n"]]) for r in kinds),
        ("", []),
        ("section", [BY_SOURCE]),
        ("bold", HEADS[2]),
        *(("", by[NAMES[s]]) for s in order),
    ]


def write(results: DataFrame, sources: dict[str, DataFrame], path: str, with_word: bool = True, file_rows: int = workbook.SHEET_ROWS - 1) -> None:
    """The report as a workbook at path: a sheet of details, with the types' colours, and one of the summary.

    More rows than a sheet holds (or file_rows) give a folder of that name with several workbooks, in order.
    """
    results = saved(results)
    lines = summary_lines(results, sources, with_word)
    colour = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair]), F.col("Tipo de inconsistencia")), F.lit("FFFFFF"))
    told = placed_rows(results, with_word).withColumn("_colour", colour)
    n_files = max(1, -(-results.count() // file_rows))
    dealt = told.repartitionById(n_files, F.floor((F.col("Lugar") - 1) / file_rows).cast("int")).sortWithinPartitions("Lugar").drop("Lugar")
    workbook.register(results.sparkSession)
    dealt.write.format("workbook").mode("overwrite").options(sheet="Detalle", colour="_colour", summary=json.dumps(lines)).save(path)


def as_bytes(results: DataFrame, sources: dict[str, DataFrame], with_word: bool = True) -> bytes:
    """The report of up to a sheet's rows, without a file that others see."""
    results = saved(results)
    if results.count() >= workbook.SHEET_ROWS:
        raise workbook.TooManyRows("the report doesn't fit a sheet")
    told = placed_rows(results, with_word)
    made = io.BytesIO()
    at = told.columns.index("Tipo de inconsistencia")
    rows_of = ((COLOURS.get(r[at], "FFFFFF"), tuple(r)[1:]) for r in told.orderBy("Lugar").toLocalIterator())
    workbook.write_file(made, told.columns[1:], rows_of, "Detalle", summary_lines(results, sources, with_word))
    return made.getvalue()
