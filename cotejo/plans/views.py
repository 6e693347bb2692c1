"""Three sources of positions derived from the table part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Number, full name, abbreviation and level of each kind of position.
KINDS = """(VALUES (0,'Dirección General','Dir. Gral.',45),(1,'Dirección Ejecutiva','Dir. Ejec.',43),(2,'Dirección','Dir.',40),
(3,'Subdirección','Subdir.',29),(4,'Jefatura de Unidad Departamental','J.U.D.',25),
(5,'Líder Coordinador de Proyectos','L.C.P.',24),(6,'Enlace','Enlace',21),(7,'Asesor','Asesor',43)) AS v(k, full_name, abbr, lvl)"""

REFERENCE = f"""SELECT p_partkey + 1 AS seq, p_partkey + 1 AS id_excel, concat(v.full_name, ' de ', p_name, ' ', p_type) AS puesto_original,
concat('Nivel ', CAST(v.lvl AS VARCHAR(10))) AS nivel_original, CASE WHEN p_partkey > 0 THEN CAST(floor((p_partkey - 1) / 3.0) AS BIGINT) + 1 END AS jefe_id
FROM {{part}} part JOIN {KINDS} ON p_partkey % 8 = v.k"""

DOCUMENT = f"""SELECT p_partkey AS seq, CASE WHEN p_partkey % 4 = 0 THEN concat(v.abbr, ' de ', p_name, ' ', p_type)
WHEN p_partkey % 4 = 1 THEN upper(concat(v.full_name, ' de ', p_name, ' ', p_type)) ELSE concat(v.full_name, ' de ', p_name, ' ', p_type) END AS puesto_original,
CAST(CASE WHEN p_partkey % 17 = 0 THEN v.lvl + 1 ELSE v.lvl END AS VARCHAR(10)) AS nivel_original
FROM {{part}} part JOIN {KINDS} ON p_partkey % 8 = v.k WHERE p_partkey % 11 <> 3"""

CHART = f"""SELECT p_partkey AS seq, CASE WHEN p_partkey % 5 = 0 THEN concat(v.abbr, ' ', p_name, ' ', p_type)
WHEN p_partkey % 5 = 1 THEN concat(v.abbr, ' de ', p_name, ' ', p_type, ' A') ELSE concat(v.abbr, ' de ', p_name, ' ', p_type) END AS puesto_original,
CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(v.lvl AS VARCHAR(10)) END AS nivel_original
FROM {{part}} part JOIN {KINDS} ON p_partkey % 8 = v.k WHERE p_partkey % 13 <> 5"""

TEXTS = {"ref": REFERENCE, "doc": DOCUMENT, "chart": CHART}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """ref, doc or chart."""
    return spark.sql(TEXTS[name], part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def sql_view(name: str) -> str:
    """The same in DuckDB's SQL."""
    return TEXTS[name].format(part="part")
