"""The rules of a comparison by name as DuckDB SQL, for the SQL counterparts of queries; written from the rules, not from the Spark plans."""

from __future__ import annotations

from cotejo import config
from cotejo.plans import duck
from cotejo.plans.duck import quoted

S = ("e", "w", "o")
NAMES = {"e": "Excel", "w": "Word", "o": "Organigrama"}
#: The order in which sources are listed in texts.
LISTED = ("e", "o", "w")
ABBREVIATIONS = "[" + ", ".join(map(quoted, config.ABBREVIATIONS)) + "]"
MODIFIERS = "[" + ", ".join(map(quoted, config.MODIFIERS)) + "]"


def alike(p: str, a: str, b: str) -> str:
    """Tables of a WITH RECURSIVE: p_f, all pairs of keys that only one of the tables a and b (k, seq) has and that reach a level by the rules, and p_m, the one-to-one choice with the equal keys.

    A pair whose edits are over 24 of 100 characters can't reach 80, even with the bonus; of the others the ratio is taken.
    """
    words = lambda x: f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda w: w <> '')), ' ')"
    side = lambda x, y: f"SELECT *, {words('k')} AS wk, {words('name')} AS wn FROM (SELECT k, seq, {duck.category('k')} AS kind, trim(substr(k, length(coalesce({duck.prefix('k')}, '')) + 1)) AS name FROM {x} WHERE k NOT IN (SELECT k FROM {y}))"
    mods = lambda x: f"list_filter({MODIFIERS}, lambda m: contains(' ' || {x} || ' ', ' ' || m || ' '))"
    tail = lambda x: f"nullif(regexp_extract({x}, ' ([a-z][0-9]{{0,2}})$', 1), '')"
    return f"""{p}_o AS MATERIALIZED ({side(a, b)}), {p}_d AS MATERIALIZED ({side(b, a)}),
    {p}_p AS MATERIALIZED (SELECT * FROM (SELECT o.k AS o_key, d.k AS d_key, o.seq AS o_seq, d.seq AS d_seq, CASE WHEN o.kind = d.kind THEN o.kind END AS shared, CASE WHEN o.kind = d.kind THEN o.name ELSE o.k END AS x,
          CASE WHEN o.kind = d.kind THEN d.name ELSE d.k END AS y, CASE WHEN o.kind = d.kind THEN o.wn ELSE o.wk END AS wx, CASE WHEN o.kind = d.kind THEN d.wn ELSE d.wk END AS wy FROM {p}_o o, {p}_d d)
          WHERE x <> '' AND y <> '' AND x <> y AND levenshtein(wx, wy) <= 0.2401 * (length(wx) + length(wy))),
    {p}_l AS MATERIALIZED (SELECT *, CAST(length(wx) + length(wy) AS DOUBLE) AS n, round({duck.ratio('wx', 'wy')} * (length(wx) + length(wy)) / 200) AS common, {duck.category('x')} AS kx, {duck.category('y')} AS ky, {mods('x')} AS mx, {mods('y')} AS my, {tail('x')} AS tx, {tail('y')} AS ty FROM {p}_p),
    {p}_j AS (SELECT *, (1 - (n - 2 * common) / n) * 100 AS base, coalesce(kx <> ky, false) OR mx <> my OR coalesce(tx <> ty, false) AS apart FROM {p}_l),
    {p}_s AS (SELECT *, NOT apart AND base >= {config.BONUS_FROM} AND coalesce(kx = ky, false) AS bonus FROM {p}_j),
    {p}_t AS (SELECT *, CASE WHEN apart THEN greatest(0, base - {config.PENALTY}) WHEN bonus THEN least(100, base + {config.BONUS}) ELSE base END AS score FROM {p}_s),
    {p}_f AS MATERIALIZED (SELECT o_key, d_key, o_seq, d_seq, round_even(score, 1) AS score, CASE WHEN score >= {config.HIGH} THEN 'fuzzy_alta' ELSE 'revision' END AS level,
          CASE WHEN shared IS NULL THEN '' ELSE 'Mismo tipo de puesto (''' || shared || '''); comparación por nombre específico (''' || x || ''' vs ''' || y || '''). ' END || 'Similitud de texto.'
          || CASE WHEN bonus THEN ' Ambos son de tipo ''' || kx || ''' (bono de confianza aplicado).' ELSE '' END AS reason FROM {p}_t WHERE score >= {config.REVIEW}),
    {p}_q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, o_seq, d_seq) AS i FROM {p}_f),
    {p}_g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS os, CAST([] AS VARCHAR[]) AS ds, false AS took
          UNION ALL SELECT q.i, CASE WHEN list_contains(os, o_key) OR list_contains(ds, d_key) THEN os ELSE list_append(os, o_key) END, CASE WHEN list_contains(os, o_key) OR list_contains(ds, d_key) THEN ds ELSE list_append(ds, d_key) END,
                 NOT (list_contains(os, o_key) OR list_contains(ds, d_key)) FROM {p}_g g JOIN {p}_q q ON q.i = g.i + 1),
    {p}_m AS MATERIALIZED (SELECT o_key, d_key, o_seq, d_seq, score, level, reason FROM {p}_q JOIN {p}_g USING (i) WHERE took
          UNION ALL SELECT a.k, b.k, a.seq, b.seq, 100.0, 'normalizada', '' FROM {a} a JOIN {b} b ON a.k = b.k)"""


def _note(a: str, b: str) -> str:
    """What known abbreviations of two normalised titles stand for; '' for none."""
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in config.ABBREVIATIONS.items())
    found = f"list_sort(list_distinct(list_filter(list_concat(string_split({a}, ' '), string_split({b}, ' ')), lambda w: list_contains({ABBREVIATIONS}, w))))"
    return f"CASE WHEN len({found}) > 0 THEN 'Equivalencia aplicada: ' || array_to_string(list_transform({found}, lambda w: upper(w) || ' → ' || CASE w {cases} END), '; ') ELSE '' END"


def _rank(level: str, a: str, b: str) -> str:
    return f"CASE {level} WHEN 'normalizada' THEN CASE WHEN {a}.t = {b}.t THEN 0 WHEN {a}.n = {b}.n THEN 1 ELSE 2 END WHEN 'fuzzy_alta' THEN 3 WHEN 'revision' THEN 4 END"


def _upper(title: str, name: str) -> str:
    return f"CASE WHEN {title} <> upper({title}) THEN '{name}: el puesto debe escribirse completamente en mayúsculas.' END"


def judged(used: tuple[str, ...], rows: str, keep: str = "") -> str:
    """Tables told to ``matched`` of rows: section, seq, key, fields of the sources, rank, score and reason of their names; keep: more columns, each with a comma before it."""
    listed = [s for s in LISTED if s in used]
    n = " + ".join(f"CAST({s}t IS NOT NULL AS INTEGER)" for s in used)
    known = f"len(list_distinct(list_filter([{', '.join(f'{s}l' for s in used)}], lambda v: v <> '')))"
    blank = " + ".join(f"CAST(coalesce({s}l = '', false) AS INTEGER)" for s in used)
    absent = ", ".join(f"CASE WHEN {s}t IS NULL THEN '{NAMES[s]}' END" for s in used)
    present = ", ".join(f"CASE WHEN {s}t IS NOT NULL THEN '{NAMES[s]}' END" for s in listed)
    shown = ", ".join(f"CASE WHEN {s}t IS NOT NULL THEN '{NAMES[s]}=' || CASE WHEN {s}l = '' THEN 'N/D' ELSE {s}l END END" for s in listed)
    unread = ", ".join(f"CASE WHEN {s}l = '' THEN '{NAMES[s]}' END" for s in listed)
    where = f"CASE WHEN np < {len(used)} THEN ' (No se encontró en: ' || concat_ws(', ', {absent}) || '.)' ELSE '' END"
    ratio = lambda a, b: f"CASE WHEN {a}t IS NULL OR {b}t IS NULL THEN 100.0 WHEN {a}t = {b}t THEN 100.0 ELSE {duck.ratio(f'{a}t', f'{b}t')} END"
    pairs = [(a, b) for i, a in enumerate(used) for b in used[i + 1 :]]
    levels = duck.levels("c")
    outside = lambda s: f"(SELECT CASE WHEN c IS NOT NULL AND {s}l <> '' AND NOT list_contains({levels}, CAST(substr({s}l, 2) AS INTEGER)) THEN '{NAMES[s]}: Nivel ' || {s}l || ' no coincide con el catálogo esperado para ''' || c || ''' (se esperaba ' || array_to_string(list_transform({levels}, lambda n: 'N' || CAST(n AS VARCHAR)), ' o ') || ').' END FROM (SELECT {duck.category(f'{s}norm')} AS c))"
    first = lambda s: f"string_split({s}t, ' ')[1]"
    strange = lambda s: f"CASE WHEN (regexp_matches({first(s)}, '^([A-ZÁÉÍÓÚÑ]\\.){{2,6}}$') OR regexp_matches({first(s)}, '^[A-ZÁÉÍÓÚÑ]{{2,6}}$')) AND NOT list_contains({ABBREVIATIONS}, {duck.title(first(s))}) THEN '{NAMES[s]}: ''' || {first(s)} || ''' parece una abreviatura pero no está en el catálogo de equivalencias (config.ABREVIATURAS_PUESTO).' END"
    warned = ", ".join(x for s in listed for x in (outside(s), strange(s)))
    names, methods = (f"[{', '.join(map(quoted, x))}]" for x in (config.NAME_LEVELS, config.METHODS))
    return f"""told AS (SELECT *, {n} AS np, {known} AS nk, {blank} AS nb FROM {rows}),
    kinds AS (SELECT *, CASE WHEN rank = 4 THEN '{config.REVISE}' WHEN rank = 3 THEN '{config.POSSIBLE}' WHEN et IS NULL THEN '{config.EXTRA}' WHEN np < {len(used)} THEN '{config.MISSING}' ELSE '{config.OK}' END AS by_name FROM told),
    typed AS (SELECT *, CASE WHEN np >= 2 AND rank < 3 AND nk > 1 THEN '{config.LEVEL_DIFFERS}' WHEN np >= 2 AND rank < 3 AND nb > 0 AND by_name = '{config.OK}' THEN '{config.LEVEL_MISSING}'
        WHEN by_name = '{config.OK}' AND rank = 1 THEN '{config.NORMALISED}' WHEN by_name = '{config.OK}' AND rank = 2 THEN '{config.EQUIVALENT}' ELSE by_name END AS kind FROM kinds),
    matched AS MATERIALIZED (SELECT section, seq, key, {', '.join(f'{s}{c}' for s in S for c in ('t', 'norm', 'l', 'lt'))}, kind{keep}, CASE kind
        WHEN '{config.REVISE}' THEN CASE WHEN reason <> '' THEN reason ELSE 'Similitud de nombre no concluyente entre fuentes.' END || {where}
        WHEN '{config.POSSIBLE}' THEN CASE WHEN reason <> '' THEN reason ELSE 'Coincidencia de nombre por similitud alta (no exacta).' END || {where}
        WHEN '{config.LEVEL_DIFFERS}' THEN 'Nivel distinto entre fuentes (' || concat_ws(', ', {shown}) || ').' || {where}
        WHEN '{config.LEVEL_MISSING}' THEN 'Nivel no especificado o no reconocido en: ' || concat_ws(', ', {unread}) || '.'
        WHEN '{config.NORMALISED}' THEN 'Mismo puesto y nivel; difieren en formato de escritura (mayúsculas/acentos/espacios).'
        WHEN '{config.EQUIVALENT}' THEN 'Mismo puesto mediante equivalencia institucional (abreviatura reconocida).'
        WHEN '{config.EXTRA}' THEN 'Puesto no encontrado en Excel (fuente de referencia). Presente en: ' || concat_ws(', ', {present}) || '.'
        WHEN '{config.MISSING}' THEN 'Falta en: ' || concat_ws(', ', {absent}) || '.' ELSE 'Presente en todas las fuentes analizadas.' END AS detail,
        {names}[rank + 1] AS name_level, {methods}[rank + 1] AS method, CASE WHEN np < 2 THEN 0.0 ELSE round_even(least(score, {', '.join(ratio(a, b) for a, b in pairs)}), 1) END AS confidence,
        concat_ws(' ', {warned}) AS catalogue_warning, concat_ws(' ', {', '.join(_upper(f'{s}t', NAMES[s]) for s in listed)}) AS format_warning, equivalence FROM typed)"""


def compared(table: str, with_word: bool) -> str:
    """WITH tables (the word RECURSIVE included) that end in ``results``: section, seq, key, titles e, w, o with levels el, wl, ol and levels as written elt, wlt, olt, kind, detail, name_level, method, confidence, equivalence, catalogue_warning, format_warning, first.

    table has fuente (ref, doc, chart), seq, puesto_original, nivel_original, normalised, k and level.
    """
    used = S if with_word else ("e", "o")
    listed = [s for s in LISTED if s in used]
    record = lambda f: f"SELECT k, arg_min(puesto_original, seq) AS t, arg_min(normalised, seq) AS n, arg_min(level, seq) AS l, arg_min(coalesce(nivel_original, ''), seq) AS lt, min(seq) AS seq FROM base WHERE fuente = '{f}' GROUP BY k"
    fields = lambda s, there=True: ", ".join(f"{f'{s}.{c}' if there else 'CAST(NULL AS VARCHAR)'} AS {s}{c if c != 'n' else 'norm'}" for c in ("t", "n", "l", "lt"))
    with_w = with_word
    main = f"""SELECT 1 AS section, e.seq, e.n AS key, {fields('e')}, {fields('w', with_w)}, {fields('o')}, {_rank('mw.level', 'e', 'w') if with_w else 'CAST(NULL AS INTEGER)'} AS rw, {_rank('mo.level', 'e', 'o')} AS ro,
        {'mw.score' if with_w else 'CAST(NULL AS DOUBLE)'} AS sw, mo.score AS so, {'mw.reason' if with_w else "''"} AS cw, mo.reason AS co FROM e LEFT JOIN eo_m mo ON mo.o_key = e.k LEFT JOIN o ON o.k = mo.d_key {'LEFT JOIN ew_m mw ON mw.o_key = e.k LEFT JOIN w ON w.k = mw.d_key' if with_w else ''}"""
    rest = f"""UNION ALL SELECT 2, w.seq, w.n, {fields('e', False)}, {fields('w')}, {fields('o')}, NULL, {_rank('m.level', 'w', 'o')}, NULL, m.score, '', m.reason FROM (SELECT w.* FROM w JOIN lw USING (k)) w LEFT JOIN wo_m m ON m.o_key = w.k LEFT JOIN o ON o.k = m.d_key"""
    last = f"""UNION ALL SELECT 3, o.seq, o.n, {fields('e', False)}, {fields('w', False)}, {fields('o')}, NULL, NULL, NULL, NULL, '', '' FROM o JOIN lo USING (k) {'WHERE o.k NOT IN (SELECT d_key FROM wo_m)' if with_w else ''}"""
    source = "CASE fuente WHEN 'ref' THEN 'Excel' WHEN 'doc' THEN 'Word' ELSE 'Organigrama' END"
    taken = " OR ".join(f"fuente = '{f}'" for f in (("ref", "doc", "chart") if with_word else ("ref", "chart")))
    own = lambda s, f, c: f"CASE WHEN fuente = '{f}' THEN {c} END AS {s}"
    dup_fields = ", ".join(own(f"{s}{c}", f, v) for s, f in (("e", "ref"), ("w", "doc"), ("o", "chart")) for c, v in (("t", "puesto_original"), ("norm", "normalised"), ("l", "level"), ("lt", "coalesce(nivel_original, '')")))
    three = f""",
    {alike('ew', 'e', 'w')}, lw AS MATERIALIZED (SELECT k, seq FROM w WHERE k NOT IN (SELECT d_key FROM ew_m)), {alike('wo', 'lw', 'lo')}""" if with_word else ""
    return f"""WITH RECURSIVE base AS MATERIALIZED (SELECT * FROM {table} WHERE trim(puesto_original) <> ''),
    e AS MATERIALIZED ({record('ref')}), w AS MATERIALIZED ({record('doc')}), o AS MATERIALIZED ({record('chart')}),
    {alike('eo', 'e', 'o')}, lo AS MATERIALIZED (SELECT k, seq FROM o WHERE k NOT IN (SELECT d_key FROM eo_m)){three},
    rows AS MATERIALIZED ({main} {rest if with_word else ''} {last}),
    named AS (SELECT *, coalesce(greatest(rw, ro), CASE WHEN section = 1 THEN 0 ELSE 1 END) AS rank, coalesce(list_min(list_filter([sw, so], lambda v: v > 0)), 100.0) AS score, concat_ws(' ', nullif(cw, ''), nullif(co, '')) AS reason, CAST(0 AS BIGINT) AS first,
        CASE WHEN section = 1 THEN coalesce({f"nullif({_note('enorm', 'wnorm')}, '')" if with_word else 'NULL'}, {_note('enorm', 'onorm')}, '') WHEN section = 2 THEN coalesce({_note('wnorm', 'onorm')}, '') ELSE '' END AS equivalence FROM rows),
    {judged(used, 'named', ', first')},
    g AS (SELECT fuente, normalised, count(*) AS n, count(DISTINCT nullif(level, '')) AS nl, string_agg('fila=' || seq, '; ' ORDER BY seq) AS places, min(seq) AS first FROM base WHERE {taken} GROUP BY fuente, normalised HAVING count(*) > 1),
    spelled AS (SELECT DISTINCT fuente, normalised, puesto_original AS t FROM base SEMI JOIN g USING (fuente, normalised)),
    least_alike AS (SELECT a.fuente, a.normalised, min({duck.ratio('a.t', 'b.t')}) AS r FROM spelled a JOIN spelled b ON a.fuente = b.fuente AND a.normalised = b.normalised AND a.t < b.t GROUP BY a.fuente, a.normalised),
    repeated AS (SELECT -1 AS section, seq, '[DUP-' || {source} || '] ' || normalised AS key, {dup_fields}, CASE WHEN nl > 1 THEN '{config.DUPLICATE_LEVEL}' ELSE '{config.DUPLICATE}' END AS kind,
        'Puesto duplicado ' || n || ' veces dentro de ' || {source} || '. Ubicaciones: ' || places AS detail, '{config.NAME_LEVELS[0]}' AS name_level, '—' AS method, coalesce(round_even(r, 1), 100.0) AS confidence, '' AS equivalence, '' AS catalogue_warning,
        CASE WHEN puesto_original <> upper(puesto_original) THEN {source} || ': el puesto debe escribirse completamente en mayúsculas.' ELSE '' END AS format_warning, first FROM base JOIN g USING (fuente, normalised) LEFT JOIN least_alike USING (fuente, normalised)),
    results AS MATERIALIZED (SELECT * FROM matched UNION ALL BY NAME SELECT * FROM repeated)"""


def homologated(with_word: bool, counted: bool = True) -> str:
    """Tables behind results: ``told_names``, results with hew, heo, hwo (states of pairs), homologation and similarity; counted: titles that a source repeats are to be revised."""
    used = S if with_word else ("e", "o")
    pairs = [(a, b) for i, a in enumerate(used) for b in used[i + 1 :]]
    key = lambda s: f"CASE WHEN {s}t IS NOT NULL THEN {duck.key(f'{s}t')} END AS {s}k"
    state = lambda a, b: f"CASE WHEN {a}k IS NULL OR {b}k IS NULL THEN 'No comparable' {f"WHEN coalesce({a}c, 0) > 1 OR coalesce({b}c, 0) > 1 THEN 'Revisar duplicados'" if counted else ''} WHEN {a}k = {b}k THEN 'Coinciden' ELSE 'No coinciden' END AS h{a}{b}"
    score = lambda a, b: f"CASE WHEN {a}k = {b}k THEN 100.0 ELSE least(99.9, round_even({duck.ratio(f'{a}k', f'{b}k')}, 1)) END"
    states = ", ".join(f"h{a}{b}" for a, b in pairs)
    joins = " ".join(f"LEFT JOIN (SELECT k AS {s}k, count(*) AS {s}c FROM base WHERE fuente = '{f}' GROUP BY k) c{s} USING ({s}k)" for s, f in (("e", "ref"), ("w", "doc"), ("o", "chart")) if s in used and counted)
    return f"""keyed_results AS (SELECT *, {', '.join(key(s) for s in used)} FROM results), counted_results AS (SELECT * FROM keyed_results {joins}),
    pair_states AS (SELECT *, {', '.join(state(a, b) for a, b in pairs)} FROM counted_results),
    told_names AS MATERIALIZED (SELECT *, CASE WHEN list_contains([{states}], 'Revisar duplicados') THEN 'Revisar duplicados' WHEN list_contains([{states}], 'No comparable') THEN 'No comparable' WHEN list_contains([{states}], 'No coinciden') THEN 'No coinciden' ELSE 'Coinciden' END AS homologation,
        CASE WHEN NOT list_contains([{states}], 'Revisar duplicados') AND NOT list_contains([{states}], 'No comparable') THEN least({', '.join(score(a, b) for a, b in pairs)}) END AS similarity FROM pair_states)"""


MAIN = "NOT starts_with(key, '[DUP-') AND key <> '[ERROR]'"


def metrics() -> str:
    """(place, metric, value) of told_names."""
    counts = [
        ("Total de puestos esperados (Excel)", f"{MAIN} AND et IS NOT NULL"),
        ("Registros revisados por ID de Excel", "false"),
        ("Registros con diferencias o pendientes de orden", "false"),
        ("Nombres coincidentes tras homologación (no valida niveles)", f"{MAIN} AND homologation = 'Coinciden'"),
        ("Encontrados en Word", f"{MAIN} AND wt IS NOT NULL"),
        ("Encontrados en Organigrama", f"{MAIN} AND ot IS NOT NULL"),
        ("Coincidencias en las tres fuentes", f"{MAIN} AND et IS NOT NULL AND wt IS NOT NULL AND ot IS NOT NULL"),
        ("Coincidencias mediante equivalencia institucional (abreviaturas)", f"{MAIN} AND kind = '{config.EQUIVALENT}'"),
        ("Faltantes reales en Word", f"{MAIN} AND et IS NOT NULL AND wt IS NULL"),
        ("Faltantes reales en Organigrama", f"{MAIN} AND et IS NOT NULL AND ot IS NULL"),
        ("Posibles coincidencias (revisar)", f"{MAIN} AND kind = '{config.POSSIBLE}'"),
        ("Requieren revisión manual (ambiguos)", f"{MAIN} AND kind = '{config.REVISE}'"),
        ("Puestos adicionales en Word (no están en Excel)", f"{MAIN} AND wt IS NOT NULL AND et IS NULL"),
        ("Puestos adicionales en Organigrama (no están en Excel)", f"{MAIN} AND ot IS NOT NULL AND et IS NULL"),
        ("Duplicados detectados", "starts_with(key, '[DUP-')"),
        ("Errores de extracción", "key = '[ERROR]'"),
    ]
    return " UNION ALL ".join(f"SELECT {i} AS place, {quoted(m)} AS metric, count(*) FILTER (WHERE {c}) AS value FROM told_names" for i, (m, c) in enumerate(counts))


def sources() -> str:
    """(source, extracted, valid, matched, possible, missing) of results; table base_all has the records as read."""
    return " UNION ALL ".join(
        f"""SELECT '{NAMES[s]}' AS source, (SELECT count(*) FROM base_all WHERE fuente = '{f}') AS extracted, (SELECT count(*) FROM base_all WHERE fuente = '{f}' AND trim(coalesce(puesto_original, '')) <> '') AS valid,
        count(*) FILTER (WHERE {MAIN} AND {s}t IS NOT NULL AND kind IN ('{config.OK}', '{config.NORMALISED}', '{config.EQUIVALENT}')) AS matched, count(*) FILTER (WHERE {MAIN} AND {s}t IS NOT NULL AND kind IN ('{config.POSSIBLE}', '{config.REVISE}')) AS possible,
        count(*) FILTER (WHERE {MAIN} AND et IS NOT NULL AND {s}t IS NULL) AS missing FROM results"""
        for s, f in (("e", "ref"), ("w", "doc"), ("o", "chart"))
    )


def report_rows(by_id: bool = False) -> str:
    """The report's columns of told_names, behind Lugar without IDs; by_id: with id, boss, oboss, pw, po, sw, so, bs, os and od."""
    names = {"e": "Excel", "w": "Word", "o": "Organigrama"}
    kind = lambda k: f"{duck.category(k)}"
    display = "CASE c " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in config.DISPLAY.items()) + " ELSE '' END"
    state = lambda s: f"""CASE WHEN {s}t IS NULL THEN '—' ELSE (SELECT CASE WHEN c IS NULL THEN 'TIPO_NO_RECONOCIDO' WHEN {s}l = '' THEN 'NO_ENCONTRADO' WHEN list_contains({duck.levels('c')}, CAST(substr({s}l, 2) AS INTEGER)) THEN 'VALIDO' ELSE 'FUERA_DE_CATALOGO' END FROM (SELECT {kind(f'{s}k')} AS c)) END"""
    shown = lambda s: f"CASE WHEN {s}t IS NULL THEN '—' ELSE {f'{s}t' if s == 'o' else duck.homologate(f'{s}t')} END"
    lost = [f"CASE WHEN {s}t IS NULL THEN {f"CASE WHEN os = '{config.CHECK_ID}' OR s{s} = '{config.UNVERIFIABLE}' THEN '{names[s]}: aparición sin asignar; consultar el detalle de orden.' ELSE " if by_id and s != 'e' else ''}'{names[s]}: puesto no encontrado en esta comparación.' {'END' if by_id and s != 'e' else ''} END" for s in LISTED]
    apart = [f"CASE h{a}{b} WHEN 'Revisar duplicados' THEN '{names[a]} vs {names[b]}: hay nombres duplicados; no se puede determinar una correspondencia única.' WHEN 'No coinciden' THEN '{names[a]} vs {names[b]}: nombres diferentes: «' || {shown(a)} || '» / «' || {shown(b)} || '».' END" for a, b in (("e", "w"), ("e", "o"), ("w", "o"))]
    said = f"concat_ws(' ', {', '.join([*lost, *apart])})"
    columns = {"Puesto (clave normalizada)": "key", "Puesto canónico": "f" if by_id else "CASE WHEN section > 0 THEN " + duck.expand(duck.title(duck.homologate("key"))) + " ELSE key END", "Tipo de puesto": display, "Nombre específico": "CASE WHEN p IS NULL THEN f ELSE trim(substr(f, length(p) + 1)) END", "Niveles según catálogo": f"coalesce(nullif(array_to_string(list_transform({duck.levels('c')}, lambda n: CAST(n AS VARCHAR)), ', '), ''), '—')"}
    for s in S:
        columns |= {f"{names[s]} - Original": f"coalesce({s}t, '—')", f"{names[s]} - Nivel": f"CASE WHEN {s}t IS NULL THEN '—' WHEN {s}lt = '' THEN 'N/D' ELSE {s}lt END", f"{names[s]} - Estado de nivel": state(s)}
    columns |= {"Resultado": f"CASE WHEN kind = '{config.OK}' THEN 'OK' ELSE 'Revisar' END", "Tipo de inconsistencia": "kind", "Nivel de coincidencia de nombre": "name_level", "Método de coincidencia": "method", "Confianza (%)": "confidence", "Motivo": "detail", "Equivalencia institucional aplicada": "equivalence", "Advertencia de catálogo (informativa)": "catalogue_warning"}
    columns |= {f"{names[s]} - Puesto homologado": shown(s) for s in S}
    columns |= {f"Homologado: {names[a]} vs {names[b]}": f"h{a}{b}" for a, b in (("e", "w"), ("e", "o"), ("w", "o"))}
    columns |= {"Resultado de homologación": "homologation", "Detalle de inconsistencia de nombres": f"CASE WHEN {said} <> '' THEN {said} WHEN homologation = 'Coinciden' THEN 'Sin diferencias de nombre tras homologación. Los niveles se validan por separado.' ELSE 'Comparación de nombres pendiente.' END", "Similitud de nombres homologados (%)": "CASE WHEN similarity IS NULL THEN 'No comparable' ELSE CAST(CAST(similarity AS DOUBLE) AS VARCHAR) END"}
    columns |= {c: "'—'" for c in ("ID esperado - Excel", "Jefe inmediato - Excel", "Posición leída - Word", "Posición leída - Organigrama", "Jefe inmediato - Organigrama")}
    columns |= {c: f"'{config.UNVERIFIABLE}'" for c in ("Orden - Word", "Orden - Organigrama", "Validación de jefe inmediato", "Resultado de orden")}
    columns |= {"Detalle de orden": "'Sin ID de referencia en Excel; solo se comparan nombres y niveles.'"}
    if by_id:
        dash = lambda c: f"coalesce(nullif(CAST({c} AS VARCHAR), ''), '—')"
        columns |= {"ID esperado - Excel": dash("id"), "Jefe inmediato - Excel": f"CASE WHEN et IS NULL THEN '—' ELSE {dash('boss')} END", "Posición leída - Word": dash("pw"), "Posición leída - Organigrama": dash("po"), "Jefe inmediato - Organigrama": f"CASE WHEN ot IS NULL THEN '—' ELSE {dash('oboss')} END"}
        columns |= {"Orden - Word": "sw", "Orden - Organigrama": "so", "Validación de jefe inmediato": "bs", "Resultado de orden": "os", "Detalle de orden": "od"}
    order = "section > 0, CASE WHEN section < 0 THEN CASE WHEN et IS NOT NULL THEN 0 WHEN wt IS NOT NULL THEN 1 ELSE 2 END ELSE section END, first, seq"
    number = "" if by_id else f'row_number() OVER (ORDER BY {order}) AS "Lugar", '
    return f"""SELECT {number}{', '.join(f'{v} AS "{k}"' for k, v in columns.items())} FROM (SELECT *, {duck.category('f')} AS c, {duck.prefix('f')} AS p FROM (SELECT *, coalesce(ek, wk, ok) AS f FROM told_names))"""


def by_id(tables: str) -> str:
    """tables (of the comparison by ID, up to q, w, o and m) and behind them results with the columns that report_rows(True) takes."""
    fields = lambda s, t, level, text: f"{t} AS {s}t, {duck.title(t)} AS {s}norm, {level} AS {s}l, coalesce({text}, '') AS {s}lt"
    none = lambda s: ", ".join(f"CAST(NULL AS VARCHAR) AS {s}{c}" for c in ("t", "norm", "l", "lt"))
    blank = lambda e: f"CASE WHEN {e}t IS NOT NULL THEN {_note('enorm', f'{e}norm')} END"
    told = """CASE WHEN wlevel <> level THEN 'Nivel: Excel=' || lt || '; Word=' || coalesce(wlt, 'N/D') || '.' END, CASE WHEN olevel <> level THEN 'Nivel: Excel=' || lt || '; Organigrama=' || coalesce(olt, 'N/D') || '.' END"""
    boss = f"CASE WHEN bs IN ('{config.AMBIGUOUS_BOSS}', '{config.OTHER_BOSS}') THEN 'Jefe inmediato: ' || bs || '. Excel: «' || boss || '»; organigrama: «' || coalesce(oboss, '') || '».' END"
    no = config.UNVERIFIABLE
    unused = lambda s, section, t, word: f"""UNION ALL SELECT {section}, seq, {duck.title('t')}, {none('e')}, {fields('w', 't', 'level', 'lt') if word else none('w')}, {none('o') if word else fields('o', 't', 'level', 'lt')}, 0, 0.0, '', '', CAST(NULL AS BIGINT), '', {'NULL' if word else 'boss'},
        {'place' if word else 'NULL'}, {'NULL' if word else 'place'}, '{no}', '{no}', '{no}', '{config.UNASSIGNED}', '{t}: aparición sin ID de Excel asignado; revisar puestos adicionales o IDs pendientes.' FROM {s} WHERE seq NOT IN (SELECT found FROM m WHERE f = '{t}' AND found IS NOT NULL)"""  # noqa: E731
    keep = ", bad, id, boss, oboss, pw, po, sw, so, bs, os, od"
    return f"""{tables}, id_rows AS (SELECT 1 AS section, seq, {duck.title('t')} AS key, {fields('e', 't', 'level', 'lt')}, {fields('w', 'wt', 'wlevel', 'wlt')}, {fields('o', 'ot', 'olevel', 'olt')}, rank, CASE WHEN rank = 4 THEN 0.0 ELSE 100.0 END AS score,
        'Puesto diferente en la posición esperada por el ID de Excel.' AS reason, bad, id, boss, oboss, pw, po, coalesce(sw, '{no}') AS sw, coalesce(so, '{no}') AS so, bs, os, concat_ws(' ', no, nw, nullif(bad, ''), {boss}, {told}) AS od FROM q
        {unused('o', 2, 'Organigrama', False)} {unused('w', 3, 'Word', True)}),
    named AS (SELECT *, CASE WHEN section = 1 THEN concat_ws(' ', {blank('w')}, {blank('o')}) ELSE '' END AS equivalence FROM id_rows),
    {judged(S, 'named', keep)},
    results AS MATERIALIZED (SELECT * REPLACE (CASE WHEN bad <> '' OR section > 1 OR os <> '{config.SAME}' AND kind IN ('{config.OK}', '{config.NORMALISED}', '{config.EQUIVALENT}') THEN '{config.REVISE}' ELSE kind END AS kind,
        CASE WHEN bad <> '' THEN 'No se puede asignar una aparición con certeza; revisar el detalle de orden.' WHEN section > 1 THEN 'Aparición sin referencia asignada; no se puede confirmar que sea adicional.' ELSE detail END AS detail), CAST(0 AS BIGINT) AS first FROM matched)"""
