"""Queries of the data-quality problems that aren't bound to training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.parsing import load_import_lines, unreadable
from ..operators.units import observations_to_convert
from ..session import table
from ..streaming.exactly_once import surplus_deliveries


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations_to_convert(table(spark, sf_dir, "fact_observation"), table(spark, sf_dir, "code_unit"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unreadable(table(spark, sf_dir, "bulk_import_line"), table(spark, sf_dir, "hl7_message"))


def p5_import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected lines per import."""
    from pyspark.sql import functions as F

    loaded = load_import_lines(table(spark, sf_dir, "bulk_import_line"))
    return loaded.groupBy("import_id").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surplus_deliveries(spark, f"{sf_dir}/hl7_message.parquet", table(spark, sf_dir, "resource_mapping"))


QUERIES = {f.__name__: f for f in (p4_found, p5_found, p5_import_report, p6_found)}

SQL = {
    "p6_found": r"""
WITH t AS (SELECT delivery_id, received_at, regexp_replace(coalesce(raw, ''), '^[\x0B\x1C\r\n]+', '') AS x FROM hl7_message),
h AS (SELECT *, regexp_replace(regexp_extract(x, '^[^\r\n]*'), '[\x0B\x1C]+$', '') AS m FROM t),
k AS (SELECT *, substr(m, 4, 1) AS s, substr(m, 5, 1) AS c, substr(m, 6, 1) AS r FROM h WHERE length(m) >= 8 AND m LIKE 'MSH%'),
f AS (SELECT *, trim(split_part(split_part(m, s, 9), c, 1)) AS ty, trim(split_part(m, s, 4)) AS fac FROM k),
i AS (SELECT *, CASE ty WHEN 'ADT' THEN split_part(m, s, 10)
    WHEN 'ORU' THEN split_part(list_filter(regexp_split_to_array(x, '[\r\n]+'), lambda y: starts_with(y, 'OBR' || s))[1], s, 4)
    WHEN 'SIU' THEN split_part(list_filter(regexp_split_to_array(x, '[\r\n]+'), lambda y: starts_with(y, 'SCH' || s))[1], s, 2)
    WHEN 'ORM' THEN split_part(list_filter(regexp_split_to_array(x, '[\r\n]+'), lambda y: starts_with(y, 'ORC' || s))[1], s, 3) END AS v FROM f),
j AS (SELECT delivery_id, received_at, ty, fac, trim(split_part(split_part(regexp_replace(v, '[\x0B\x1C]+$', ''), r, 1), c, 1)) AS id FROM i)
SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY ty, fac, id ORDER BY received_at, delivery_id) AS n FROM j WHERE id <> '') WHERE n > 1
""",
}
