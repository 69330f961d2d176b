"""Queries of the star schema: metrics with disclosure control, over the domain and the order tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.disclosure import suppress
from ..plans.metrics import CATALOGUE, Metric, group_columns, measure, predicate, run_metric
from ..plans.schema import CLINICAL
from ..session import table


def _observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    fact = table(spark, sf_dir, "fact_observation")
    return fact, {**{d: table(spark, sf_dir, d) for d in ("dim_code", "dim_cohort", "dim_organization")}}


def _catalogue(name: str, *group_by: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        fact, dims = _observations(spark, sf_dir)
        return run_metric(CATALOGUE[name], fact, dims, group_by=group_by or None, every_organization=True)

    return query


def _own(measure_name: str, column: str | None = None, group: str = "dim_code.display", **k: object):
    """A metric of our own over observations, without suppression."""
    metric = Metric("own", "fact_observation", measure_name, column, group_by=(group,), subject="patient_key", **k)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        fact, dims = _observations(spark, sf_dir)
        metric.validate(CLINICAL)
        rows, keys = group_columns(fact, metric, metric.group_by, dims)
        return measure(rows, metric, keys)

    return query


def m_total_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    sets = li.groupingSets([["l_returnflag"], []], "l_returnflag")
    return sets.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.grouping_id().cast("long").alias("is_total"))


def f_all_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = table(spark, sf_dir, "fact_observation")
    filters = {
        "eq": ("status", "eq", "final"), "ne": ("status", "ne", "final"), "in_": ("unit", "in", ["mmol/L", "g/L"]), "not_in": ("unit", "not_in", ["mmol/L", "g/L"]), "gt": ("value", "gt", 10.0),
        "gte": ("value", "gte", 10.0), "lt": ("value", "lt", 10.0), "lte": ("value", "lte", 10.0), "is_true": ("is_abnormal", "is_true"), "is_false": ("is_abnormal", "is_false"), "is_null": ("unit", "is_null"), "not_null": ("unit", "not_null"),
    }
    return fact.agg(*[F.count_if(predicate(f)).alias(k) for k, f in filters.items()])


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = rows.groupBy("c_mktsegment", "n_name").agg(F.count("*").cast("double").alias("value"), F.countDistinct("c_custkey").alias("subjects"))
    return cells, rows.agg(F.count("*").cast("double").alias("total"))


def d_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, total = _cells(spark, sf_dir)
    return suppress(cells, total, ["c_mktsegment", "n_name"], 11, additive=False)


def d_complementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = table(spark, sf_dir, "fact_observation")
    joined = fact.join(table(spark, sf_dir, "dim_code"), "code_key")
    cells = joined.groupBy("display").agg(F.count("*").cast("double").alias("value"), F.countDistinct("patient_key").alias("subjects"))
    low = cells.agg((F.min("subjects") + 1).alias("k")).collect()[0]["k"] or 1  # one number
    return suppress(cells, joined.agg(F.count("*").cast("double").alias("total")), ["display"], int(low), additive=True)


def d_by_organization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per code in the report of each organisation, with its total or that it is withheld."""
    fact = table(spark, sf_dir, "fact_observation").join(table(spark, sf_dir, "dim_code"), "code_key")
    cells = fact.groupBy("organization_id", "display").agg(F.count("*").cast("double").alias("value"), F.countDistinct("patient_key").alias("subjects"))
    return suppress(cells, None, ["organization_id", "display"], 11, additive=True, reports=("organization_id",), with_total=True)


def d_total_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell per report: where it is small, its total would give it away."""
    cells = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").cast("double").alias("value"), F.countDistinct("s_suppkey").alias("subjects"))
    return suppress(cells, None, ["s_nationkey"], 5, additive=True, reports=("s_nationkey",), with_total=True)


def d_nonadditive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages don't add up, so only small cells are suppressed."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = rows.groupBy("c_mktsegment", "n_name").agg(F.round(F.avg("c_acctbal"), 4).alias("value"), F.countDistinct("c_custkey").alias("subjects"))
    return suppress(cells, None, ["c_mktsegment", "n_name"], 11, additive=False)


#: Facts that the driver's tables don't have, made of those it has; the text runs in both engines.
DERIVED = {
    "fact_adverse_event": "SELECT observation_key AS event_key, patient_key, cohort_key, code_key AS drug_code_key, 'none' AS event_code_key, organization_key, unit AS seriousness, is_abnormal AS is_serious, organization_id, date_key, load_id FROM fact_observation",
    "fact_encounter": "SELECT CAST(o_orderkey AS STRING) AS encounter_key, CAST(o_custkey AS STRING) AS patient_key, 'c' AS cohort_key, CAST(o_custkey % 25 AS STRING) AS organization_key, CASE WHEN o_orderstatus = 'O' THEN 'IMP' ELSE 'AMB' END AS encounter_class, CAST(o_orderkey % 29 AS DOUBLE) AS length_of_stay_days, o_orderstatus = 'P' AS is_readmission, 'org' AS organization_id, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS date_key, 'l' AS load_id FROM orders",
    "fact_document_ingestion": "SELECT CAST(doc_id AS STRING) AS document_key, source AS source_key, organization_id AS organization_key, document_type, 1 AS page_count, 1 AS chunk_count, CAST(n_chars AS DOUBLE) AS processing_ms, false AS used_ocr, CAST(n_chars % 100 AS DOUBLE) AS quality_score, doc_id % 10 <> 0 AS succeeded, organization_id, year(ingested_at) * 10000 + month(ingested_at) * 100 + day(ingested_at) AS date_key, 'l' AS load_id FROM documents",
    "fact_answer": "SELECT CAST(event_id AS STRING) AS answer_key, CAST(user_id % 25 AS STRING) AS role_key, 'o' AS organization_key, event_type AS question_category, 'm' AS response_mode, value AS latency_ms, 1 AS citation_count, event_id % 3 <> 0 AS is_grounded, event_id % 7 = 0 AS was_abstained, 'org' AS organization_id, year(ts) * 10000 + month(ts) * 100 + day(ts) AS date_key, 'l' AS load_id FROM events",
    "fact_phi_access": "SELECT CAST(o_orderkey AS STRING) AS access_key, CAST(o_custkey % 25 AS STRING) AS role_key, 'o' AS organization_key, o_orderpriority AS purpose, o_orderstatus AS outcome, o_orderkey % 4 = 0 AS was_break_glass, o_orderkey % 3 = 0 AS was_reviewed, 'org' AS organization_id, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS date_key, 'l' AS load_id FROM orders",
    "fact_job_run": "SELECT CAST(o_orderkey AS STRING) AS run_key, 'o' AS organization_key, CASE WHEN o_orderpriority = '1-URGENT' THEN 'deidentification' ELSE 'load' END AS job_kind, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'succeeded' END AS status, o_totalprice AS duration_ms, 1 AS rows_processed, 0 AS rows_rejected, 'org' AS organization_id, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS date_key, 'l' AS load_id FROM orders",
    "dim_actor_role": "SELECT CAST(n_nationkey AS STRING) AS role_key, n_name AS role, false AS is_service_account FROM nation",
    "dim_source_system": "SELECT DISTINCT source AS source_key, source AS source_system, 'c' AS channel, 'i' AS interface_kind FROM documents WHERE source IS NOT NULL",
}
_TABLES = ("fact_observation", "orders", "documents", "events", "nation", "dim_code", "dim_cohort", "dim_organization")


def _derived(name: str, *group_by: str):
    """A metric of the catalogue over a derived fact."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        metric = CATALOGUE[name]
        frames = {t: table(spark, sf_dir, t) for t in _TABLES}

        def made(t: str) -> DataFrame:
            return spark.sql(re.sub(r"FROM (\w+)", r"FROM {\1}", DERIVED[t]), **{k: v for k, v in frames.items() if f"FROM {k}" in DERIVED[t]})

        dims = {d: made(d) if d in DERIVED else frames[d] for d in CLINICAL.dimensions if d in DERIVED or d in frames}
        return run_metric(metric, made(metric.fact), dims, group_by=group_by or None, every_organization=True)

    return query


def e_organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fact_observation").where("organization_id is not null and organization_id <> ''").groupBy("organization_id").agg(F.count("*").alias("rows"))


def q_tenant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = table(spark, sf_dir, "fact_observation")
    return fact.where((F.col("organization_id") == "org:001") & F.col("date_key").between(20260101, 20260131)).select("observation_key", "code_key", "value", "date_key", "load_id")


QUERIES = {
    "metric_cohort_patient_count": _catalogue("cohort_patient_count"), "metric_cohort_by_age": _catalogue("cohort_patient_count", "dim_cohort.age_band"),
    "metric_abnormal_result_rate": _catalogue("abnormal_result_rate"), "metric_abnormal_by_organization": _catalogue("abnormal_result_rate", "dim_organization.organization_name"),
    "m_count": _own("count"), "m_count_zero_group": _own("count", filters=(("unit", "eq", "mmol/L"),)), "m_count_distinct": _own("count_distinct", "unit"),
    "m_ratio": _own("ratio", filters=(("is_abnormal", "is_true"),), denominator=(("status", "not_in", ("cancelled",)),)),
    "m_sum": _own("sum", "value"), "m_average": _own("average", "value"), "m_min": _own("min", "value"), "m_max": _own("max", "value"), "m_percentile_floor": _own("percentile", "value"),
    "j_unknown_dimension": _own("count", group="dim_cohort.risk_band"), "m_total_grouping_sets": m_total_grouping_sets, "f_all_operators": f_all_operators, "d_primary": d_primary,
    "d_complementary": d_complementary, "d_by_organization": d_by_organization, "d_total_withheld": d_total_withheld, "d_nonadditive": d_nonadditive, "e_organizations": e_organizations, "q_tenant_scan": q_tenant_scan,
}

#: The catalogue over derived facts; dim_code of adverse events is reached by the first of two keys.
DERIVED_METRICS = {
    "metric_adverse_event_count": ("adverse_event_count",), "j_role_playing": ("adverse_event_count", "dim_code.display"), "metric_serious_adverse_event_rate": ("serious_adverse_event_rate",), "metric_mean_length_of_stay": ("mean_length_of_stay", "dim_date.month"),
    **{f"metric_{n}": (n,) for n in ("documents_ingested", "ingestion_success_rate", "ingestion_p95_latency", "mean_extraction_quality", "etl_job_failure_count", "phi_access_count", "break_glass_count", "break_glass_review_rate", "deidentification_job_status", "answers_produced", "grounding_pass_rate", "abstention_rate", "answer_p95_latency")},
    "metric_answers_by_role": ("answers_produced", "dim_actor_role.role"),
}
QUERIES |= {name: _derived(*args) for name, args in DERIVED_METRICS.items()}

_OBS = "SELECT o.*, coalesce(c.display, 'unknown') AS dim_code__display FROM fact_observation o LEFT JOIN dim_code c ON o.code_key = c.code_key"
_SUBJ = "count(DISTINCT CASE WHEN {0} AND patient_key <> '' THEN patient_key END) AS subjects"


def _prefix(cells: str, total: str, keys: str, minimum: str) -> str:
    """The loop over the smallest cells as windows."""
    return f"""
WITH cells AS ({cells}), t AS ({total}), a AS (SELECT cells.*, t.total, subjects > 0 AND subjects < {minimum} AS p FROM cells, t),
b AS (SELECT *, sum(p::INT) OVER () AS np, sum(CASE WHEN p THEN 0 ELSE value END) OVER () AS op,
  row_number() OVER (PARTITION BY p ORDER BY value, {keys}) AS k, sum(value) OVER (PARTITION BY p ORDER BY value, {keys} ROWS UNBOUNDED PRECEDING) AS s FROM a),
c AS (SELECT *, min(CASE WHEN NOT p AND np + k >= 2 AND total - (op - s) > 0 THEN k END) OVER () AS f, count(*) OVER () AS n FROM b),
d AS (SELECT *, CASE WHEN np = 0 OR (np >= 2 AND total - op > 0) THEN 0 ELSE coalesce(f, n) END AS take FROM c)
SELECT {keys}, CASE WHEN NOT (p OR k <= take) THEN value END AS value, subjects, p OR k <= take AS suppressed,
  CASE WHEN p THEN 'small_cell' WHEN k <= take THEN 'complementary' END AS reason FROM d"""


def _flat(value: str, keys: str, source: str, rows: str = "TRUE") -> str:
    return f"SELECT * FROM (SELECT {keys}, {value} AS value, {_SUBJ.format(rows)} FROM ({source}) GROUP BY {keys}) WHERE value IS NOT NULL"


def _published(inner: str, keys: str) -> str:
    """Primary suppression only, for measures that don't add up."""
    return f"SELECT {keys}, CASE WHEN NOT (subjects > 0 AND subjects < 11) THEN value END AS value, subjects, subjects > 0 AND subjects < 11 AS suppressed, CASE WHEN subjects > 0 AND subjects < 11 THEN 'small_cell' END AS reason FROM ({inner})"


_RATE = "round(count(*) FILTER (WHERE status NOT IN ('entered-in-error', 'cancelled') AND is_abnormal) / nullif(count(*) FILTER (WHERE status NOT IN ('entered-in-error', 'cancelled')), 0), 6)"
_MONTH = "SELECT *, substr(date_key::VARCHAR, 1, 4) || '-' || substr(date_key::VARCHAR, 5, 2) AS dim_date__month FROM fact_observation"

SQL = {
    "metric_cohort_patient_count": _published(_flat("count(DISTINCT patient_key)::DOUBLE", "dim_date__month", _MONTH), "dim_date__month"),
    "metric_cohort_by_age": _published(_flat("count(DISTINCT patient_key)::DOUBLE", "dim_cohort__age_band", "SELECT o.*, CASE WHEN c.cohort_key IS NULL THEN 'unknown' ELSE c.age_band END AS dim_cohort__age_band FROM fact_observation o LEFT JOIN dim_cohort c ON o.cohort_key = c.cohort_key"), "dim_cohort__age_band"),
    "metric_abnormal_result_rate": _published(_flat(_RATE, "dim_code__display", _OBS, "status NOT IN ('entered-in-error', 'cancelled')"), "dim_code__display"),
    "metric_abnormal_by_organization": _published(_flat(_RATE, "dim_organization__organization_name", "SELECT o.*, CASE WHEN g.organization_key IS NULL THEN 'unknown' ELSE g.organization_name END AS dim_organization__organization_name FROM fact_observation o LEFT JOIN dim_organization g ON o.organization_key = g.organization_key", "status NOT IN ('entered-in-error', 'cancelled')"), "dim_organization__organization_name"),
    "m_count": _flat("count(*)::DOUBLE", "dim_code__display", _OBS),
    "m_count_zero_group": _flat("count(*) FILTER (WHERE unit = 'mmol/L')::DOUBLE", "dim_code__display", _OBS, "unit = 'mmol/L'"),
    "m_count_distinct": _flat("count(DISTINCT unit)::DOUBLE", "dim_code__display", _OBS),
    "m_ratio": _flat("round(count(*) FILTER (WHERE status NOT IN ('cancelled') AND is_abnormal) / nullif(count(*) FILTER (WHERE status NOT IN ('cancelled')), 0), 6)", "dim_code__display", _OBS, "status NOT IN ('cancelled')"),
    "m_sum": _flat("round(sum(value), 6)", "dim_code__display", _OBS),
    "m_average": _flat("round(avg(value), 6)", "dim_code__display", _OBS), "m_min": _flat("min(value)", "dim_code__display", _OBS), "m_max": _flat("max(value)", "dim_code__display", _OBS),
    "m_percentile_floor": _flat("list_sort(list(value) FILTER (WHERE value IS NOT NULL))[greatest(1, floor(count(value) * 0.95)::INT)]", "dim_code__display", _OBS),
    "j_unknown_dimension": _flat("count(*)::DOUBLE", "dim_cohort__risk_band", "SELECT o.*, CASE WHEN c.cohort_key IS NULL THEN 'unknown' ELSE c.risk_band END AS dim_cohort__risk_band FROM fact_observation o LEFT JOIN dim_cohort c ON o.cohort_key = c.cohort_key"),
    "m_total_grouping_sets": "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, grouping(l_returnflag)::BIGINT AS is_total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())",
    "f_all_operators": "SELECT count(*) FILTER (WHERE status = 'final') AS eq, count(*) FILTER (WHERE status <> 'final') AS ne, count(*) FILTER (WHERE unit IN ('mmol/L', 'g/L')) AS in_, count(*) FILTER (WHERE unit NOT IN ('mmol/L', 'g/L')) AS not_in, count(*) FILTER (WHERE value > 10) AS gt, count(*) FILTER (WHERE value >= 10) AS gte, count(*) FILTER (WHERE value < 10) AS lt, count(*) FILTER (WHERE value <= 10) AS lte, count(*) FILTER (WHERE is_abnormal) AS is_true, count(*) FILTER (WHERE NOT is_abnormal) AS is_false, count(*) FILTER (WHERE unit IS NULL) AS is_null, count(*) FILTER (WHERE unit IS NOT NULL) AS not_null FROM fact_observation",
    "d_primary": "SELECT c_mktsegment, n_name, CASE WHEN n >= 11 THEN n::DOUBLE END AS value, n AS subjects, n < 11 AS suppressed, CASE WHEN n < 11 THEN 'small_cell' END AS reason FROM (SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)",
    "d_complementary": _prefix(
        "SELECT display, count(*)::DOUBLE AS value, count(DISTINCT patient_key) AS subjects FROM fact_observation JOIN dim_code USING (code_key) GROUP BY display",
        "SELECT count(*)::DOUBLE AS total FROM fact_observation JOIN dim_code USING (code_key)", "display", "((SELECT min(subjects) FROM cells) + 1)",
    ),
    "e_organizations": "SELECT organization_id, count(*) AS rows FROM fact_observation WHERE organization_id <> '' GROUP BY organization_id",
    "q_tenant_scan": "SELECT observation_key, code_key, value, date_key, load_id FROM fact_observation WHERE organization_id = 'org:001' AND date_key BETWEEN 20260101 AND 20260131",
}


def _condition(f: tuple) -> str:
    name, op, *value = f
    return {"is_true": name, "is_false": f"NOT {name}", "not_null": f"{name} IS NOT NULL", "eq": f"{name} = '{value[0]}'" if value else "", "not_in": f"{name} NOT IN {value[0]}" if value else ""}[op]


def _metric_sql(name: str, *group_by: str) -> str:
    m, g = CATALOGUE[name], (group_by or CATALOGUE[name].group_by)[0]
    key, via = g.replace(".", "__"), {v: k for k, v in reversed(CLINICAL.facts[m.fact].dimensions.items())}.get(g.split(".")[0])
    y, mo = "substr(CAST(date_key AS STRING), 1, 4)", "substr(CAST(date_key AS STRING), 5, 2)"
    if g == "dim_date.month":
        source = f"SELECT *, {y} || '-' || {mo} AS {key} FROM ({DERIVED[m.fact]})"
    elif g == "dim_date.quarter":
        source = f"SELECT *, {y} || '-Q' || ((CAST({mo} AS INT) + 2) // 3)::VARCHAR AS {key} FROM ({DERIVED[m.fact]})"
    elif "." in g:
        dim, column = g.split(".")
        d = CLINICAL.dimensions[dim].key
        source = f"SELECT f.*, CASE WHEN d.{d} IS NULL THEN 'unknown' ELSE d.{column} END AS {key} FROM ({DERIVED[m.fact]}) f LEFT JOIN ({DERIVED.get(dim, 'SELECT * FROM ' + dim)}) d ON f.{via} = d.{d}"
    else:
        source = f"SELECT *, {g} AS {key} FROM ({DERIVED[m.fact]})" if g != key else DERIVED[m.fact]
    hit = " AND ".join(map(_condition, m.filters)) or "TRUE"
    base = " AND ".join(map(_condition, m.denominator)) or "TRUE"
    rows = base if m.measure == "ratio" else hit
    value = {
        "count": f"count(*) FILTER (WHERE {hit})::DOUBLE", "ratio": f"round(count(*) FILTER (WHERE ({base}) AND ({hit})) / nullif(count(*) FILTER (WHERE {base}), 0), 6)",
        "average": f"round(avg({m.column}) FILTER (WHERE {hit}), 6)", "percentile": f"list_sort(list({m.column}) FILTER (WHERE {hit} AND {m.column} IS NOT NULL))[greatest(1, floor(count({m.column}) * {m.percentile})::INT)]",
    }[m.measure]
    subjects = _SUBJ.format(rows) if m.subject else f"count(*) FILTER (WHERE {rows}) AS subjects"
    cells = f"SELECT * FROM (SELECT {key}, {value} AS value, {subjects} FROM ({source}) GROUP BY {key}) WHERE value IS NOT NULL"
    if m.measure == "count":
        return _prefix(cells, f"SELECT sum(value) AS total FROM ({cells})", key, str(m.minimum_cell))
    small = f"subjects > 0 AND subjects < {m.minimum_cell}"
    return f"SELECT {key}, CASE WHEN NOT ({small}) THEN value END AS value, subjects, {small} AS suppressed, CASE WHEN {small} THEN 'small_cell' END AS reason FROM ({cells})"


def _reports(cells: str, report: str, keys: str, minimum: int) -> str:
    """Suppression per report, with totals."""
    return f"""
WITH cells AS ({cells}), a AS (SELECT *, sum(value) OVER (PARTITION BY {report}) AS t, subjects > 0 AND subjects < {minimum} AS p FROM cells),
b AS (SELECT *, sum(p::INT) OVER (PARTITION BY {report}) AS np, sum(CASE WHEN p THEN 0 ELSE value END) OVER (PARTITION BY {report}) AS op,
  row_number() OVER (PARTITION BY {report}, p ORDER BY value, {keys}) AS k, sum(value) OVER (PARTITION BY {report}, p ORDER BY value, {keys} ROWS UNBOUNDED PRECEDING) AS s FROM a),
c AS (SELECT *, min(CASE WHEN NOT p AND np + k >= 2 AND t - (op - s) > 0 THEN k END) OVER (PARTITION BY {report}) AS f, count(*) OVER (PARTITION BY {report}) AS n FROM b),
d AS (SELECT *, CASE WHEN np = 0 OR (np >= 2 AND t - op > 0) THEN 0 ELSE coalesce(f, n) END AS take FROM c),
e AS (SELECT *, p OR k <= take AS hidden FROM d),
g AS (SELECT *, np > 0 AND (sum(hidden::INT) OVER (PARTITION BY {report}) < 2 OR t - sum(CASE WHEN hidden THEN 0 ELSE value END) OVER (PARTITION BY {report}) <= 0) AS total_withheld FROM e)
SELECT {keys}, CASE WHEN NOT hidden THEN value END AS value, subjects, hidden AS suppressed, CASE WHEN p THEN 'small_cell' WHEN hidden THEN 'complementary' END AS reason, CASE WHEN NOT total_withheld THEN t END AS total, total_withheld FROM g"""


SQL |= {name: _metric_sql(*args) for name, args in DERIVED_METRICS.items()}
SQL |= {
    "d_by_organization": _reports("SELECT organization_id, display, count(*)::DOUBLE AS value, count(DISTINCT patient_key) AS subjects FROM fact_observation JOIN dim_code USING (code_key) GROUP BY ALL", "organization_id", "organization_id, display", 11),
    "d_total_withheld": _reports("SELECT s_nationkey, count(*)::DOUBLE AS value, count(DISTINCT s_suppkey) AS subjects FROM supplier GROUP BY ALL", "s_nationkey", "s_nationkey", 5),
    "d_nonadditive": "SELECT c_mktsegment, n_name, CASE WHEN n >= 11 THEN v END AS value, n AS subjects, n < 11 AS suppressed, CASE WHEN n < 11 THEN 'small_cell' END AS reason FROM (SELECT c_mktsegment, n_name, count(*) AS n, round(avg(c_acctbal), 4) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)",
}
