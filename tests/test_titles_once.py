"""Texts of a row's title."""

from cotejo.operators import cells

CELLS = "file string, sheet string, row int, col int, value string"


def test_a_title_is_normalised_once_for_a_row(spark):
    lines = [("Denominación del puesto", "Nivel"), ("Enlace", "21"), ("  ", "20"), ("DENOMINACIÓN DEL PUESTO", "Nivel"), ("Total de plazas", "7"), ("Asesor", "43")]
    given = spark.createDataFrame([("f", "s", r, 9 + c, v) for r, line in enumerate(lines, 1) for c, v in enumerate(line, 1)], CELLS)
    found = cells.records(given)
    assert sorted((r.row, r.puesto_original) for r in found.collect()) == [(2, "Enlace"), (6, "Asesor")]
    kept = found._jdf.queryExecution().analyzed().toString().split("\n")[0]
    assert kept.startswith("Filter") and kept.count("puesto_original") == 1
