"""The comparison by ID on small cases."""

from pyspark.sql import functions as F

from cotejo import config
from cotejo.operators import by_id
from cotejo.operators.by_id import compare_by_id
from cotejo.operators.reconcile import classify, duplicates, report_sections, three_way

E = "seq long, id_excel long, puesto_original string, nivel_original string, jefe_inmediato string"
C = "seq long, puesto_original string, nivel_original string, jefe_inmediato string, jerarquia_verificada boolean, error_orden string, posicion_lectura long"
W = "seq long, puesto_original string, nivel_original string"


def chart(spark, rows, verified=True):
    return spark.createDataFrame([(i, t, n, b, verified, "", i) for i, (t, n, b) in enumerate(rows, 1)], C)


def run(spark, excel, word, chart_rows, verified=True):
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(excel, 1)], E)
    w = spark.createDataFrame([(i, *r) for i, r in enumerate(word, 1)], W) if word is not None else None
    found = compare_by_id(e, w, chart(spark, chart_rows, verified)).collect()
    return {(r.section, r.seq): r for r in found}


ROWS = [(1, "Dirección General", "45", None), (2, "Enlace de Compras", "21", "Dirección General"), (3, "Enlace de Ventas", "21", "Dirección General")]


def test_all_in_place(spark):
    got = run(spark, ROWS, [r[1:3] for r in ROWS], [(t, n, b) for _, t, n, b in ROWS])
    assert len(got) == 3
    for i in (1, 2, 3):
        r = got[1, i]
        assert (r.kind, r.order_state, r.position_word, r.position_organigrama, r.homologation, r.similarity, r.confidence) == (config.OK, config.SAME, i, i, "Coinciden", 100.0, 100.0)
    assert got[1, 1].boss_state == config.NO_BOSS and got[1, 2].boss_state == config.BOSS_AGREES
    assert got[1, 2].order_detail == "Organigrama: coincide en posición 2. Word: coincide en posición 2."


def test_moved_missing_and_left_over(spark):
    got = run(spark, ROWS, [ROWS[0][1:3], ROWS[2][1:3], ("Asesor", "43")], [(t, n, b) for _, t, n, b in ROWS])
    two, three, rest = got[1, 2], got[1, 3], got[3, 3] if (3, 3) in got else None
    assert two.order_word == config.NOT_FOUND and three.order_word == config.MOVED
    assert "Encontrado en diferente posición; realizar ajuste. Word: posición 2; esperada 3 según Excel. En la posición esperada se leyó «Asesor»." in three.order_detail
    assert two.kind == config.REVISE and two.detail.startswith("Puesto diferente en la posición esperada por el ID de Excel.") and two.confidence == 0.0
    assert two.order_state == config.NOT_FOUND and three.order_state == config.MOVED
    assert rest is None  # the third record was read at the place of ID 3


def test_ids_missing_and_repeated(spark):
    rows = [(1, "A uno", "21", None), (None, "B dos", "21", None), (3, "C tres", "21", None), (3, "D cuatro", "21", None)]
    got = run(spark, rows, None, [("A uno", "21", None), ("B dos", "21", None), ("C tres", "21", None)])
    assert {i: got[1, i].order_state for i in (1, 2, 3, 4)} == {1: config.SAME, 2: config.CHECK_ID, 3: config.CHECK_ID, 4: config.CHECK_ID}
    assert got[1, 2].order_detail == "ID vacío o inválido." and got[1, 3].order_detail == "ID repetido: 3."
    left = got[2, 2]
    assert left.kind == config.REVISE and left.order_state == config.UNASSIGNED and left.position_organigrama == 2 and left.confidence == 0.0


def test_unreliable_chart_is_not_reused(spark):
    rows = [(1, "Enlace", "21", None), (2, "Enlace", "21", None)]
    got = run(spark, rows, None, [("Enlace", "21", None)], verified=False)
    assert got[1, 1].organigrama is not None and got[1, 2].organigrama is None
    assert got[1, 2].order_detail == "Organigrama: nombre repetido sin posición verificable; no se reutiliza otra aparición." and got[1, 2].kind == config.REVISE
    assert got[1, 1].order_state == config.UNVERIFIABLE and got[1, 1].position_organigrama is None and got[1, 1].boss_state == config.UNVERIFIABLE


def test_bosses(spark):
    rows = [(1, "Jefe A", "40", None), (2, "Jefe B", "40", None), (3, "Enlace", "21", "Jefe A"), (4, "Enlace", "21", "Jefe B"), (5, "Asesor", "43", "[ID de jefe no resoluble: 9]")]
    chart_rows = [("Jefe A", "40", None), ("Jefe B", "40", None), ("Enlace", "21", "Jefe B"), ("Enlace", "21", "Jefe A"), ("Asesor", "43", "Jefe A")]
    got = run(spark, rows, [r[1:3] for r in rows], chart_rows)
    assert got[1, 3].order_organigrama == config.MOVED and got[1, 3].boss_state == config.OTHER_BOSS
    assert "Nombre/nivel repetidos" in got[1, 3].order_detail and "Jefe inmediato: Jefe inmediato diferente. Excel: «Jefe A»; organigrama: «Jefe B»." in got[1, 3].order_detail
    assert got[1, 5].order_state == config.UNVERIFIABLE and "corregir la referencia del jefe inmediato." in got[1, 5].order_detail


def test_errors_and_no_rows(spark):
    e = spark.createDataFrame([(1, 1, "A", "21", None, None), (2, None, "", None, None, "ilegible")], E + ", error string")
    got = compare_by_id(e, None, chart(spark, []).limit(0)).collect()
    assert sorted((r.section, r.seq, r.kind) for r in got) == [(-2, 2, config.ERROR), (1, 1, config.REVISE)]


def test_results_by_name(spark):
    e = spark.createDataFrame([(1, "Compras", "21"), (2, "***", None), (3, "J.U.D. de Ventas", "25"), (4, "Enlace de Apoyo", "21"), (5, "enlace de apoyo", "22")], W)
    w = spark.createDataFrame([(1, "COMPRAS", "21"), (2, "Jefatura de Unidad Departamental de Ventas", "25")], W)
    o = spark.createDataFrame([(1, "COMPRAS", "21"), (2, "Jefatura de Unidad Departamental de Ventas", None)], W)
    got = {(r.section, r.seq): r for r in classify(three_way(e, w, o)).collect()}
    assert (got[1, 1].kind, got[1, 1].confidence) == (config.NORMALISED, 14.3)
    assert got[1, 1].detail == "Mismo puesto y nivel; difieren en formato de escritura (mayúsculas/acentos/espacios)."
    assert (1, 2) in got and got[1, 2].kind == config.MISSING and got[1, 2].confidence == 0.0
    assert got[1, 3].kind == config.LEVEL_MISSING and got[1, 3].equivalence == "Equivalencia aplicada: JUD → jefatura de unidad departamental"
    assert got[1, 1].format_warning == "Excel: el puesto debe escribirse completamente en mayúsculas."
    found = {r.seq: r for r in duplicates(e, "Excel").collect()}
    assert sorted(found) == [4, 5] and found[4].key == "[DUP-Excel] enlace de apoyo" and found[4].kind == config.DUPLICATE_LEVEL
    assert found[4].detail == "Puesto duplicado 2 veces dentro de Excel. Ubicaciones: fila=4; fila=5" and found[4].confidence == round(100 * 26 / 30, 1)
    sections = report_sections({"excel": e.withColumn("error", F.when(F.col("seq") == 1, "roto")), "organigrama": o}).groupBy("section").count().collect()
    assert {r.section: r["count"] for r in sections} == {-2: 1, -1: 2, 1: 3, 3: 1}


def test_places_are_listed_for_ambiguous_rows_alone(spark):
    """Rows carry the number of their candidates; the places, which grow with the square of a group, are joined last."""
    rows = spark.sql("SELECT 9L AS id_excel, 1L AS seq, 'a' AS key, 'N1' AS level, 'b' AS boss, 'b' AS boss_key")
    records = spark.sql("SELECT CAST(id AS LONG) AS position, 'a' AS key, IF(id < 4, 'N1', 'N2') AS level, 'b' AS boss_key, id > 1 AS verified FROM range(1, 6)")
    found = by_id._found(rows, records, True)
    assert not [f for f in found.schema if f.dataType.typeName() == "array"]
    r = found.first()
    assert (r.n, r.at, r.n_like) == (2, 2, 3)
    unsure = found.select("seq", "group", F.lit("<").alias("note"), F.lit(">").alias("after"))
    assert by_id._listed(unsure, records).collect() == [(1, "<2, 3>")]
