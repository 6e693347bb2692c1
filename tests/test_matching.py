"""Matching, trees, lines and the report against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from cotejo import config
from cotejo.functions import similarity
from cotejo.operators import by_id, hierarchy, lines, matching, reconcile
from cotejo.plans import report

W = "seq long, puesto_original string, nivel_original string"


def table_ratio(a, b):
    """Normalised Indel similarity by the whole table."""
    last = [0] * (len(b) + 1)
    for c in a:
        row = [0]
        for j, d in enumerate(b):
            row.append(last[j] + 1 if c == d else max(last[j + 1], row[j]))
        last = row
    return 200.0 * last[-1] / (len(a) + len(b)) if a or b else 100.0


def titles(seed):
    rng = random.Random(seed)
    kinds = ["Dirección General", "Dirección", "Subdirección", "J.U.D.", "Jefatura de Unidad Departamental", "Enlace", "Asesor", "Coordinador", "Vice"]
    areas = ["Compras", "Compras y Ventas", "Recursos Humanos", "Recursos Materiales", "Apoyo A", "Apoyo B", "Apoyo", "Control", "Controles", "Archivo General", ""]
    out = [f"{rng.choice(kinds)} {rng.choice(['de ', '', 'del '])}{rng.choice(areas)}".strip() for _ in range(60)] + ["***", "x"]
    return [(i, t.upper() if rng.random() < 0.2 else t, rng.choice(["21", "25", None])) for i, t in enumerate(out, 1)]


def test_similar_names_and_assignment(spark, monkeypatch):
    o, d = (matching.representatives(spark.createDataFrame(titles(s), W)) for s in (1, 2))
    mine, theirs = ({r.key: r.seq for r in x.collect()} for x in (o, d))
    assert "" in mine
    monkeypatch.setattr(similarity, "ratios", lambda xs, ys: np.array([table_ratio(x, y) for x, y in zip(xs, ys, strict=True)]))
    expected = {}
    for a in mine.keys() - theirs.keys():
        for b in theirs.keys() - mine.keys():
            score, level, reason = similarity.judge_parts(a, b)
            if level in ("fuzzy_alta", "revision"):
                expected[a, b] = (score, level, reason)
    found = matching.fuzzy_pairs(o, d).collect()
    assert {(r.o_key, r.d_key): (r.score, r.level, r.reason) for r in found} == expected and len(expected) > 5
    free_o, free_d, chosen = set(mine), set(theirs), {}
    for k in mine.keys() & theirs.keys():
        chosen[k] = k
    free_o, free_d = free_o - set(chosen), free_d - set(chosen)
    for a, b in sorted(expected, key=lambda p: (-expected[p][0], mine[p[0]], theirs[p[1]])):
        if a in free_o and b in free_d:
            chosen[a] = b
            free_o.discard(a)
            free_d.discard(b)
    assert {r.o_key: r.d_key for r in matching.match(o, d).collect()} == chosen


def test_report(spark):
    sources = {n: spark.createDataFrame(titles(s), W) for n, s in (("excel", 1), ("word", 2), ("organigrama", 3))}
    with_error = sources["excel"].withColumn("error", F.when(F.col("seq") == 3, "ilegible"))
    found = report.homologation(reconcile.report_sections(sources | {"excel": with_error}), sources | {"excel": with_error}).cache()
    rows = report.rows(found).collect()
    assert len(rows[0]) == 41 and len(rows) == found.count()
    assert all(v is not None for r in rows for v in r)
    metrics = {r.metric: r.value for r in report.summary(found).collect()}
    assert len(metrics) == 16 and metrics["Errores de extracción"] == 1
    main = [r for r in rows if not r[0].startswith("[")]
    assert metrics["Encontrados en Word"] == sum(r["Word - Original"] != "—" for r in main)
    assert metrics["Coincidencias en las tres fuentes"] == sum("—" not in (r["Excel - Original"], r["Word - Original"], r["Organigrama - Original"]) for r in main)
    by_source = {r.source: r for r in report.by_source(found, sources | {"excel": with_error}).collect()}
    assert by_source["Excel"].valid == 61 and by_source["Word"].missing == metrics["Faltantes reales en Word"]
    two = {s: sources[s] for s in ("excel", "organigrama")}
    short = report.homologation(reconcile.report_sections(two), two, with_word=False)
    assert len(report.rows(short, with_word=False).columns) == 33 and report.summary(short, with_word=False).count() == 12
    excel = sources["excel"].withColumn("id_excel", F.col("seq"))
    told = by_id.compare_by_id(excel, sources["word"], sources["organigrama"])
    assert len(report.rows(report.homologation(told.drop("homologation", "similarity"), None)).columns) == 41


def test_long_ranks_and_deep_trees(spark):
    big = 20_000_000_000
    edges = [(1, 0, None, 5), (1, 1, 0, big + 2), (1, 2, 0, big + 1), (1, 3, 0, -7), (1, 4, 2, 1), (2, 0, None, 0)]
    edges += [(3, i, i - 1 if i else None, 1) for i in range(300)] + [(4, 1, 2, 0), (4, 2, 1, 0), (4, 3, 99, 0)]
    got = {(r.tree, r.node): (r.depth, r.position) for r in hierarchy.preorder(spark.createDataFrame(edges, "tree int, node int, parent int, rank long")).collect()}
    assert [got[1, n] for n in (0, 3, 2, 4, 1)] == [(0, 1), (1, 2), (1, 3), (2, 4), (1, 5)] and got[2, 0] == (0, 1)
    assert all(got[3, i] == (i, i + 1) for i in range(300)) and got[4, 1] == got[4, 2] == got[4, 3] == (None, None)


def test_lines(spark):
    pages = {
        "a": ["1 Jefatura de", "2 Enlace de Compras 20", "y Ventas 25"],
        "b": ["1 Jefatura de Unidad Contable", 'y Financiera "A" 25'],
        "c": ["Total 25", "página 3", "Enlace de Apoyo 21", "12 Ab 3", "Dirección 40"],
        "d": [None, "", "3 Uno", "4 Dos", "de Tres 29"],
    }
    rows = [(f, 1, i, t) for f, ts in pages.items() for i, t in enumerate(ts, 1)]
    got = {}
    for r in lines.pattern_records(spark.createDataFrame(rows, "file string, page int, line_no int, text string")).collect():
        got.setdefault(r.file, []).append((r.line_no, r.cantidad, r.puesto_original, r.nivel_original))
    assert sorted(got["a"]) == [(2, "2", "Enlace de Compras", "20"), (3, None, "y Ventas", "25")]
    assert got["b"] == [(1, "1", 'Jefatura de Unidad Contable y Financiera "A"', "25")]
    assert sorted(got["c"]) == [(3, None, "Enlace de Apoyo", "21"), (5, None, "Dirección", "40")]
    assert got["d"] == [(3, "3", "Uno de Tres", "29")]


def test_boss_headers(spark):
    from cotejo.operators.cells import columns

    heads = [(10, "Denominación del puesto"), (11, "Nivel"), (12, "DENOMINACIÓN DEL PUESTO DEL JEFE INMEDIATO")]
    cells = spark.createDataFrame([("f", "s", 2, c, v) for c, v in heads], "file string, sheet string, row int, col int, value string")
    r = columns(cells).first()
    assert (r.title_col, r.level_col, r.boss_col) == (10, 11, 12) and len(config.BOSS_HEADERS) == 8


def test_common_lengths():
    rng = random.Random(8)
    words = ["", "a", "\0", "\0a", "ñandú", "x" * 64, "x" * 65, "".join(rng.choices("ab", k=200)), "".join(rng.choices("abcdefgh", k=130)), *("".join(rng.choices("abc de", k=rng.randrange(90))) for _ in range(60))]
    a, b = zip(*[(x, y) for x in words for y in rng.sample(words, 20)], strict=True)
    got = similarity.ratios(list(a), list(b))
    assert [round(v, 9) for v in got.tolist()] == [round(table_ratio(x, y), 9) for x, y in zip(a, b, strict=True)]


def test_similar_pairs_leave_nothing_out(spark, monkeypatch):
    """Random strings of few letters, short ones too, in small squares, against all pairs."""
    from cotejo.operators import likeness

    monkeypatch.setattr(likeness, "MEET", 7)
    rng = random.Random(1)
    kind = "block string, id long, word string, slack double, mods long, tail long"
    make = lambda n: "".join(rng.choices("abcdé ", k=n))
    stems = [make(rng.randrange(1, 30)) for _ in range(25)]

    def near(stem):
        s = list(stem)
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s))] = make(rng.randrange(3))
        return "".join(s)

    sides = []
    for _ in range(2):
        rows = [(b, i, near(rng.choice(stems)) or None, s, rng.randrange(2), rng.randrange(3)) for i, (b, s) in enumerate(rng.choices([("x", 0.24), ("y", 0.2), ("z", 0.3)], k=150))]
        sides.append(rows)
    want = {(o[1], d[1]) for o in sides[0] for d in sides[1] if o[0] == d[0] and o[2] and d[2] and table_ratio(o[2], d[2]) >= 100 * (1 - o[3]) - 1e-9 and o[4] == d[4] and (o[5] == d[5] or not o[5] or not d[5])}
    found = likeness.similar_pairs(*(spark.createDataFrame(s, kind) for s in sides)).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want and len(want) > 80
    assert likeness.similar_pairs(spark.createDataFrame([], kind), spark.createDataFrame(sides[1], kind)).count() == 0


def greedy(pairs):
    used, out = (set(), set()), set()
    for o, d, o_seq, d_seq, score, level, _ in sorted(pairs, key=lambda p: (p[5] != "normalizada", -p[4], p[2], p[3])):
        if o not in used[0] and d not in used[1]:
            used[0].add(o)
            used[1].add(d)
            out.add((o, d))
    return out


def test_assignment_of_a_long_chain(spark, monkeypatch):
    """10,000 links, each better than the one before it: a chain of as many rounds, taken in a few."""
    from cotejo.plans import graphs, saved

    made = []
    write = saved.saved
    monkeypatch.setattr(matching, "saved", lambda df: (made.append(1), write(df))[1])
    monkeypatch.setattr(graphs, "saved", lambda df: (made.append(1), write(df))[1])
    kind = "o_key string, d_key string, o_seq long, d_seq long, score double, level string, reason string"
    chain = [(f"o{i // 2}", f"d{(i + 1) // 2}", i // 2, (i + 1) // 2, 80 + i / 1000, "revision", "") for i in range(10_000)]
    rng = random.Random(3)
    mixed = [(f"p{a}", f"q{b}", a, b, float(rng.randrange(80, 100)), rng.choice(["fuzzy_alta", "revision"]), "") for a in range(40) for b in rng.sample(range(40), 3)]
    frame = spark.createDataFrame(chain + mixed, kind)
    for most in (10_050, 20_000):  # by components, and all in one
        made.clear()
        got = {(r.o_key, r.d_key) for r in matching.assign(frame, most).collect()}
        assert got == greedy(chain + mixed) and len(made) < 30
    by_rounds = {(r.o_key, r.d_key) for r in matching.assign(spark.createDataFrame(mixed, kind), most=10).collect()}
    assert by_rounds == greedy(mixed)
    assert matching.assign(spark.createDataFrame([], kind)).count() == 0


def test_components(spark):
    from cotejo.plans.graphs import components

    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(7, 7), (1000, 1000)] + [(i, i + 1) for i in range(2000, 2300)] + [(5000, i) for i in range(5001, 5200)]
    least = {n: n for ab in links for n in ab}
    for _ in range(400):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == least


def test_tour_of_any_shape(spark):
    """Random forests, a chain and a star against a walk."""
    from cotejo.plans import graphs

    rng = random.Random(6)
    edges = [("r", i, rng.randrange(i) if i and rng.random() > 0.05 else None, rng.choice([1, 2, None])) for i in range(120)]
    edges += [("chain", i, i - 1 if i else None, 0) for i in range(700)] + [("star", i, 0 if i else None, -i) for i in range(300)] + [("lost", 1, 9, 0), ("lost", 2, 1, 0), ("round", 1, 2, 0), ("round", 2, 1, 0), ("round", 3, None, 0)]
    children = {}
    for tree, node, parent, rank in edges:
        children.setdefault((tree, parent), []).append((rank is not None, rank or 0, node))
    want = {(t, n): (None, None) for t, n, _, _ in edges}
    for tree in {e[0] for e in edges}:
        stack, place = [(n, 0) for *_, n in sorted(children.get((tree, None), []), reverse=True)], 0
        while stack:
            node, depth = stack.pop()
            place += 1
            want[tree, node] = (depth, place)
            stack += [(n, depth + 1) for *_, n in sorted(children.get((tree, node), []), reverse=True)]
    frame = spark.createDataFrame(edges, "tree string, node int, parent int, rank long")
    for df in (hierarchy.preorder(frame), graphs.orders(frame, most=250)):  # walked, and the chain and the star by doubling
        assert {(r.tree, r.node): (r.depth, r.position) for r in df.collect()} == want


def test_a_chain_of_100000_nodes(spark):
    from cotejo.plans import graphs

    i = F.col("id")
    chain = spark.range(100_000).select(F.lit("t").alias("tree"), i.alias("node"), F.when(i > 0, i - 1).alias("parent"), F.lit(0).cast("long").alias("rank"))
    told = graphs.orders(chain)
    assert told.where(F.col("position") == F.col("node") + 1).where(F.col("depth") == F.col("node")).count() == 100_000
