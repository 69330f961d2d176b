"""Queries over clinical messages and person records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.linkage import identifier_conflicts
from ..session import table
from ..sources import messages as M


def h_acknowledgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.validate(M.parse(table(spark, sf_dir, "hl7_message"))).groupBy("message_type", "acknowledgement").agg(F.count("*").alias("n"))


def h_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.results(table(spark, sf_dir, "hl7_message"))


def h_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.parse(table(spark, sf_dir, "hl7_message"))
    return p.where("segments is not null").select("delivery_id", M.field("PID", 3).alias("mrn"), M.field("PID", 5).alias("family"), M.field("PID", 5, 2).alias("given"), M.field("PID", 8).alias("sex"))


def h_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier conflicts: one system and value under several holders, here the digits of telephone numbers under several records."""
    p = table(spark, sf_dir, "person_record").select("record_id", F.explode("telecom").alias("t")).select("record_id", F.col("t.system").alias("system"), F.regexp_replace("t.value", r"[^0-9]", "").alias("value"))
    return identifier_conflicts(p, "record_id")


QUERIES = {f.__name__: f for f in (h_acknowledgements, h_results, h_patients, h_identifiers)}
_PART = "nullif(replace(replace(replace(replace(replace(split_part(split_part(split_part(line, s, {0}), r, 1), c, 1), e || 'F' || e, s), e || 'S' || e, c), e || 'R' || e, r), e || 'T' || e, b), e || 'E' || e, e), '')"
SQL = {
    "h_results": r"""WITH t AS (SELECT delivery_id, regexp_replace(coalesce(raw, ''), '^[\x0B\x1C\r\n]+', '') AS x FROM hl7_message), h AS (SELECT *, regexp_replace(regexp_extract(x, '^[^\r\n]*'), '[\x0B\x1C]+$', '') AS m FROM t),
k AS (SELECT delivery_id, substr(m, 4, 1) AS s, substr(m, 5, 1) AS c, substr(m, 6, 1) AS r, substr(m, 7, 1) AS e, substr(m, 8, 1) AS b, list_filter(regexp_split_to_array(x, '[\r\n]+'), lambda y: NOT regexp_matches(y, '^[\s\x0B\x1C]*$')) AS ls FROM h WHERE length(m) >= 8 AND m LIKE 'MSH%'),
u AS (SELECT *, unnest(ls) AS l, (generate_subscripts(ls, 1) - 1)::INT AS position FROM k), v AS (SELECT *, regexp_replace(l, '[\x0B\x1C]+$', '') AS line FROM u WHERE starts_with(l, 'OBX' || s))
SELECT delivery_id, position, """ + ", ".join(f"{_PART.format(n + 1)} AS {name}" for n, name in ((3, "code"), (5, "value"), (6, "unit"), (11, "status"))) + " FROM v",
    "h_patients": r"""WITH t AS (SELECT delivery_id, regexp_replace(coalesce(raw, ''), '^[\x0B\x1C\r\n]+', '') AS x FROM hl7_message), h AS (SELECT *, regexp_replace(regexp_extract(x, '^[^\r\n]*'), '[\x0B\x1C]+$', '') AS m FROM t),
k AS (SELECT delivery_id, substr(m, 4, 1) AS s, substr(m, 5, 1) AS c, substr(m, 6, 1) AS r, substr(m, 7, 1) AS e, substr(m, 8, 1) AS b, regexp_split_to_array(x, '[\r\n]+') AS ls FROM h WHERE length(m) >= 8 AND m LIKE 'MSH%'),
v AS (SELECT *, regexp_replace(list_filter(ls, lambda y: starts_with(y, 'PID' || s))[1], '[\x0B\x1C]+$', '') AS line FROM k)
SELECT delivery_id, """ + ", ".join(f"{_PART.format(n + 1).replace(', c, 1)', f', c, {k})')} AS {name}" for n, k, name in ((3, 1, "mrn"), (5, 1, "family"), (5, 2, "given"), (8, 1, "sex"))) + " FROM v",
    "h_identifiers": "SELECT system, value, count(DISTINCT record_id) AS holders FROM (SELECT record_id, unnest(telecom).system AS system, regexp_replace(unnest(telecom).value, '[^0-9]', '', 'g') AS value FROM person_record) WHERE value <> '' GROUP BY ALL HAVING count(DISTINCT record_id) > 1",
}
