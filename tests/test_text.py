"""Column functions and the scorer on single values."""

import random

import pytest
from pyspark.sql import functions as F

from cotejo.functions import catalogue, similarity, text
from cotejo.operators import cells, hierarchy, lines, matching, reconcile, sequence
from cotejo.plans import report
from cotejo.sources import office


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", column(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_titles(spark):
    assert one(spark, text.normalise_title, "  Dirección\nGENERAL – de  «Áreas» ", None, "J.U.D. de “Compras”", "Año – 2", "ﬁn") == ["direccion general-de areas", "", "jud de compras", "ano-2", "fin"]
    assert one(spark, text.normalise_level, "8", "Nivel 8", "NIVEL 8", "N-8", "Nvl. 8", "008", "", None, "x", "25.0") == ["N8"] * 6 + ["", "", "", "N25"]
    assert one(spark, text.homologate, "Jefatura de Unidad Departamental de Compras", "j u d", "LÍDER coordinador de proyectos A", "  Enlace", "Judas") == ["J.U.D. de Compras", "J.U.D.", "L.C.P. A", "  Enlace", "Judas"]
    assert one(spark, text.comparison_key, "Dir. Gral. de TI", "J.U.D. de X", "J. U. D. de X", "Jefe de Unidad Departamental de X") == ["direccion general de ti"] + ["jefatura de unidad departamental de x"] * 3
    assert one(spark, text.unknown_abbreviation, "D.G.A. de X", "ENLACE de", "J.U.D. x", "Titular") == [
        *[f"'{w}' parece una abreviatura pero no está en el catálogo de equivalencias (config.ABREVIATURAS_PUESTO)." for w in ("D.G.A.", "ENLACE")],
        None,
        None,
    ]
    assert one(spark, text.suffix, "enlace a", "a", "enlace b12", "enlace 12") == ["a", None, "b12", None]
    assert one(spark, text.modifiers, "encargado de la direccion", "vice ministro", "direccion") == [["encargado de"], ["vice"], []]
    assert one(spark, text.parse_id, None, "", "PUESTO", "0", "-1", "1.5", "True", "NaN", "Infinity", "11.0", "1e1", " 7 ") == [None] * 9 + [11, 10, 7]


def test_catalogue(spark):
    assert one(spark, catalogue.category, "jud de x", "direccion general", "direccion generala", "secretaria particular", "secretaria particular de x", "asesor") == ["jefatura de unidad departamental", "direccion general", "direccion", None, "secretaria", None]
    assert one(spark, catalogue.specific_name, "direccion general de x", "asesor b") == ["de x", "asesor b"]
    rows = spark.createDataFrame([("direccion", "N40"), ("direccion", "N1"), ("direccion", ""), ("asesor", "N1")], "k string, l string")
    assert [r.s for r in rows.select(catalogue.level_state(catalogue.category(F.col("k")), F.col("l")).alias("s")).collect()] == ["VALIDO", "FUERA_DE_CATALOGO", "NO_ENCONTRADO", "TIPO_NO_RECONOCIDO"]


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcñ ", k=rng.randrange(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert similarity.common_lengths([a], [b])[0] == row[-1]


@pytest.mark.parametrize(
    ("a", "b", "level"),
    [
        ("director de recursos humanos", "subdirector de recursos humanos", "sin_coincidencia"),
        ("coordinador de sistemas", "coordinadora de sistema", "fuzzy_alta"),
        ("enlace de control a", "enlace de control b", "sin_coincidencia"),
        ("lider coordinador de proyectos", "coordinador de proyectos", "revision"),
        ("direccion de recursos humanos y servicios generales", "direccion recursos humanos y servicios generales", "fuzzy_alta"),
        ("direccion de recursos humanos", "direccion recursos humanos", "revision"),
        ("encargado de compras", "compras", "sin_coincidencia"),
    ],
)
def test_judge(a, b, level):
    assert similarity.judge_parts(a, b)[1] == level


def source(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, puesto_original string, nivel_original string")


def test_three_way(spark):
    excel = source(spark, ("Jefatura de Unidad Departamental de Compras", "25"), ("Dirección de Finanzas", "40"), ("Enlace de Archivo", "20"), ("Subdirección de Recursos Humanos y Servicios Generales", "29"), ("", "1"), ("Asesor único", None))
    word = source(spark, ("J.U.D. de Compras", "25"), ("Dirección de Finanzas", "39"), ("Subdirección Recursos Humanos y Servicios Generales", "29"), ("Coordinación nueva", "34"))
    chart = source(spark, ("JUD de Compras", "25"), ("DIRECCIÓN DE FINANZAS", "40"), ("Subdirección de Recursos Humanos y Servicios Generales", "29"), ("Coordinación Nueva", "34"), ("Asesor único", "1"))
    got = {r.key: r for r in reconcile.classify(reconcile.three_way(excel, word, chart)).collect()}
    assert len(got) == 6
    assert got["jefatura de unidad departamental de compras"].kind == "Coincidencia mediante equivalencia institucional"
    assert got["direccion de finanzas"].kind == "Nivel inconsistente" and got["direccion de finanzas"].detail == "Nivel distinto entre fuentes (Excel=N40, Organigrama=N40, Word=N39)."
    assert (got["enlace de archivo"].kind, got["enlace de archivo"].detail, got["enlace de archivo"].confidence) == ("Puesto faltante", "Falta en: Word, Organigrama.", 0.0)
    assert got["subdireccion de recursos humanos y servicios generales"].kind == "Posible coincidencia" and got["subdireccion de recursos humanos y servicios generales"].confidence >= 93
    assert got["coordinacion nueva"].kind == "Puesto adicional" and got["coordinacion nueva"].section == 2
    two = reconcile.classify(reconcile.three_way(excel, None, chart), with_word=False).collect()
    assert not any("Word" in (r.detail or "") for r in two)
    assert sum(r.kind == "Puesto adicional" for r in got.values()) == 1 and sum(r.kind == "Puesto faltante" for r in got.values()) == 2


def test_assignment_is_greedy(spark):
    rng = random.Random(6)
    pairs = [(f"o{i}", f"d{j}", i, j, float(rng.randrange(80, 90)), "revision") for i in range(9) for j in range(9) if rng.random() < 0.6]
    free_o, free_d, expected = set(), set(), set()
    for o, d, *_ in sorted(pairs, key=lambda p: (-p[4], p[2], p[3])):
        if o not in free_o and d not in free_d:
            free_o.add(o)
            free_d.add(d)
            expected.add((o, d))
    frame = spark.createDataFrame(pairs, "o_key string, d_key string, o_seq long, d_seq long, score double, level string")
    assert {(r.o_key, r.d_key) for r in matching.assign(frame).collect()} == expected


def test_fuzzy_pairs_lose_nothing(spark):
    rng = random.Random(7)
    kinds = ["direccion de ", "enlace ", "", "jefatura de unidad departamental "]
    name = lambda: rng.choice(kinds) + " ".join(rng.choices(["compras", "compra", "obras", "obra publica", "sistemas", "a", "b"], k=rng.randrange(1, 5)))
    a, b = sorted({name() for _ in range(60)}), sorted({name() for _ in range(60)})
    o, d = (matching.representatives(source(spark, *[(t, None) for t in s])) for s in (a, b))
    got = {(r.o_key, r.d_key, r.score) for r in matching.fuzzy_pairs(o, d).collect()}
    ka, kb = {r.key for r in o.collect()}, {r.key for r in d.collect()}
    expected = {(x, y, similarity.judge_parts(x, y)[0]) for x in ka - kb for y in kb - ka if similarity.judge_parts(x, y)[1] != "sin_coincidencia"}
    assert got == expected


def test_sequence(spark):
    reference = spark.createDataFrame([(i, i, f"Puesto {chr(64 + i)}{i}", "1", None) for i in range(1, 7)], "seq long, id_excel long, puesto_original string, nivel_original string, jefe_id long")
    order = [1, 2, 4, 3, 5]
    found = spark.createDataFrame([(k, f"puesto {chr(64 + i)}{i}", "1") for k, i in enumerate(order)], "seq long, puesto_original string, nivel_original string")
    got = {r.id_excel: (r.state, r.detail) for r in sequence.order_state(reference, found).collect()}
    assert got[3] == ("Diferente posición", "posición 4; esperada 3") and got[1] == ("Misma posición", "") and got[6] == ("Puesto no encontrado", "")
    wide = spark.range(200_000, 0, -3).select(F.col("id").alias("seq"))
    placed = sequence.with_position(wide)
    assert placed.where("position <> (seq - 2) / 3 + 1").count() == 0
    ids = spark.createDataFrame([(i, v) for i, v in enumerate(["1", "1", None, "4"])], "seq long, id_text string")
    assert [r.error_id for r in sequence.id_problems(ids).orderBy("seq").collect()] == ["ID duplicado", "ID duplicado", "ID ausente o no válido", ""]


def test_hierarchy(spark):
    edges = spark.createDataFrame([("t", "a", None, 1), ("t", "b", "a", 2), ("t", "c", "a", 1), ("t", "d", "b", 1), ("t", "x", "y", 1), ("t", "y", "x", 1)], "tree string, node string, parent string, rank int")
    assert {r.node: r.position for r in hierarchy.preorder(edges).collect()} == {"a": 1, "c": 2, "b": 3, "d": 4, "x": None, "y": None}
    assert hierarchy.tree_problems(edges.where("node NOT IN ('x', 'y')")).first().sound


def test_sheets_and_lines(spark):
    grid = [["", "x"], ["CANTIDAD", "DENOMINACION DEL PUESTO", "NIVEL"], ["1", "Enlace", "20"], ["", "TOTAL ACTUAL", ""], ["", "Puesto", "Nivel"], ["2", "Asesor", ""]]
    table = spark.createDataFrame([("f", "s", r + 1, c + 1, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "file string, sheet string, row int, col int, value string")
    assert [(r.puesto_original, r.nivel_original) for r in cells.records(table).orderBy("row").collect()] == [("Enlace", "20"), ("Asesor", "")]
    rows = spark.createDataFrame([("f", 0, i + 1, r) for i, r in enumerate([["Cantidad", "Denominación del puesto", "Nivel"], ["1", "Enlace", "20"], ["", "Total: 3", ""], ["2", " Asesor ", "43"]])], "file string, table_idx int, row_idx int, cells array<string>")
    assert [(r.puesto_original, r.cantidad) for r in cells.table_records(rows).orderBy("row_idx").collect()] == [("Enlace", "1"), ("Asesor", "2")]
    told = spark.createDataFrame([("f", 1, i, t) for i, t in enumerate(['1 Jefatura Contable', 'y Financiera "A" 25', "Enlace 20", "nada"])], "file string, page int, line_no int, text string")
    assert [(r.puesto_original, r.nivel_original, r.cantidad) for r in lines.pattern_records(told).orderBy("line_no").collect()] == [('Jefatura Contable y Financiera "A"', "25", "1"), ("Enlace", "20", None)]
    boxes = spark.createDataFrame([(i, t) for i, t in enumerate(["Dirección Nivel 40", "Enlace 20 de 7", "Asesor Asesor", "Sin"])], "i int, t string").select("i", lines.clean_box(F.col("t")).alias("b")).orderBy("i").collect()
    assert [(r.b.title, r.b.level) for r in boxes] == [("Dirección", "Nivel 40"), ("Enlace de 7", "20"), ("Asesor", None), ("Sin", None)]


def test_report(spark, tmp_path):
    excel = source(spark, ("Enlace de Archivo", "20"), ("Enlace de Archivo", "21"), ("Asesor", "43"))
    chart = source(spark, ("Enlace de Archivo", None), ("Asesora", "43"), ("Otro", "1"))
    sources = {"excel": excel, "organigrama": chart}
    found = report.homologation(reconcile.classify(reconcile.three_way(excel, None, chart), with_word=False), sources, with_word=False)
    states = {r.key: (r.homologation, r.similarity) for r in found.collect()}
    assert states["enlace de archivo"] == ("Revisar duplicados", None) and states["otro"] == ("No comparable", None)
    assert states["asesor"][0] in ("No coinciden", "No comparable")
    rows = {r["Puesto (clave normalizada)"]: r for r in report.rows(found, with_word=False).collect()}
    assert rows["enlace de archivo"]["Organigrama - Nivel"] == "N/D" and rows["otro"]["Excel - Original"] == "—" and rows["otro"]["Resultado"] == "Revisar"
    shares = {r.source: r for r in report.by_source(found, sources).collect()}
    assert (shares["Excel"].extracted, shares["Excel"].valid) == (3, 3) and shares["Organigrama"].missing <= 1
    report.write(found, sources, str(tmp_path / "r.xlsx"), with_word=False)
    back = office.read_workbooks(spark, str(tmp_path))
    assert back.where("error IS NOT NULL").count() == 0 and back.where("sheet = 'Detalle' AND value = 'enlace de archivo'").count() >= 1


def test_a_title_is_read_once_for_its_key(spark):
    """However often a function names a value, the plan makes it once."""
    df = spark.createDataFrame([("Dir. de Área",)], "only_title string")
    name = text.homologate(F.col("only_title"))
    for made in (text.comparison_key(F.col("only_title")), catalogue.level_state(catalogue.category(name), F.lit("N40")), catalogue.specific_name(name), catalogue.warning(name, F.lit("N40")), text.suffix(name), text.modifiers(name), lines.clean_box(F.col("only_title")), text.is_noise(name, ["^a", "b$"])):
        plan = df.select(made.alias("made"))._jdf.queryExecution().optimizedPlan().toString()
        project = plan[: plan.rindex("LogicalRDD")]
        assert project.count("only_title") == 1, project
