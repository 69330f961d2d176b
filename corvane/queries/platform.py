"""Queries of the façade, populations, loads, mapping, documents, logs and graph search, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import mapping
from ..functions.text import HEADING
from ..operators import evidence, graph, loads, population, retrieval
from ..plans.facade import Dashboard, default_registry, freshness
from ..session import table
from ..streaming import events as ev
from ..streaming import log
from .operators import SQL as OPERATORS


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    return table(spark, sf_dir, "fact_observation"), {d: table(spark, sf_dir, d) for d in ("dim_code", "dim_cohort", "dim_organization")}


def q_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, dims = _facts(spark, sf_dir)
    return default_registry().ask("abnormal_result_rate", fact, dims, "org:001", {"analyst"}, {"from": "2026-01-01", "to": "2026-06-30"})


def q_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, dims = _facts(spark, sf_dir)
    board = Dashboard("results", (("abnormal_result_rate", "dim_code.display"), ("cohort_patient_count", "dim_cohort.sex")))
    return board.render(default_registry(), {"fact_observation": fact}, dims, "org:001", {"analyst"})


def q_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness(table(spark, sf_dir, "fact_observation"), "org:001")


def p_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a large order and no pending one."""
    return population.cohort(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_totalprice") > 300000, F.col("o_orderstatus") == "P")


def s_series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.series_summary(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_shipdate", "l_quantity")


def s_longitudinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.longitudinal(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice")


def s_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("organization_id", F.col("doc_id").alias("event_id"), F.col("effective_date").alias("day"))
    o = table(spark, sf_dir, "fact_observation").groupBy("organization_id", "load_id").agg(F.lit(None).cast("date").alias("day")).select("organization_id", F.col("load_id").alias("event_id"), "day")
    return population.timeline({"documents": d, "loads": o}, "organization_id")


def c_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.recency(table(spark, sf_dir, "documents"), "source", "effective_date", F.lit("2026-06-01").cast("date"))


def c_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.agreement(table(spark, sf_dir, "documents"), "organization_id", "document_type")


def c_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each section heading stands in its text."""
    c = table(spark, sf_dir, "retrieval_candidate").select("id", "section_heading", "text").distinct()
    return c.select("id", F.round(evidence.coverage(F.col("section_heading"), F.col("text")), 6).alias("coverage"))


def e_incremental_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "fact_observation")
    middle = "load-2026-03"
    return loads.after_cursor(f, "load_id", middle).groupBy("load_id").agg(F.count("*").alias("rows"), F.count_if(F.col("date_key") >= 20260101).alias("recent"))


def e_numeric_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.after_cursor(table(spark, sf_dir, "events"), "event_id", "1000", numeric=True).groupBy("event_type").agg(F.count("*").alias("rows"))


def e_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.statistics(table(spark, sf_dir, "fact_observation"), "organization_id", "load_id")


def e_run_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs per priority."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded").alias("status"), F.col("o_orderdate").alias("finished"), F.col("o_orderpriority").alias("kind"))
    return loads.retain(runs, 50, "kind").select("id", "kind", "status")


def e_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.lit("orders").alias("fact"), F.col("o_orderkey").cast("long").alias("cursor"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "partial").otherwise("succeeded").alias("status"))
    held = table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.concat(F.lit("9-"), F.col("n_nationkey").cast("string")).alias("source"), F.lit("orders").alias("fact"), F.col("n_nationkey").cast("long").alias("cursor"))
    return loads.advance(held, runs)


def e_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("attempt"), F.round(loads.backoff(F.col("n_nationkey"), 0.5, 2.0, 300.0), 4).alias("seconds"))


def x_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order fields as message fields of uneven precision."""
    digits = F.date_format("o_orderdate", "yyyyMMdd")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.substr(F.concat(digits, F.lit("0930")), F.lit(1), ((F.col("o_orderkey") % 5) * 2 + 4).cast("int")).alias("stamp"),
        F.substring("o_orderpriority", 1, 1).alias("rank"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("<0.5")).otherwise(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))).alias("amount"), F.concat(F.lit("Clerk#"), F.col("o_custkey").cast("string")).alias("o_clerk"), F.col("o_orderstatus").alias("sex_code"), F.lower(F.substring("o_orderpriority", 3, 1)).alias("flag"),
    )
    rules = {
        "day": ("stamp", "date", {}), "moment": ("stamp", "datetime", {"timezone": "+02:00"}), "strict": ("stamp", "instant", {}), "level": ("rank", "code_lookup", {"codes": {"1": "high", "2": "high", "3": "medium"}}),
        "number": ("amount", "decimal", {}), "clerk": ("o_clerk", "reference", {"resource_type": "Practitioner", "prefix": "c/"}), "sex": ("sex_code", "sex", {}), "yes": ("flag", "boolean", {"true": ("U", "H"), "false": ("L",)}), "plain": ("amount", "trim", {}), "upper": ("flag", "upper", {}), "fixed": ("flag", "constant", {"value": "x"}),
    }
    m = mapping.map_fields(o, rules, ["o_orderkey"])
    return m.withColumn("unmapped", F.array_join("unmapped", ","))


def t_document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    c = D.classify(F.col("text"), F.array_join(D.section_headings(F.col("text")), " "))
    return d.select("doc_id", c.alias("c")).select("doc_id", "c.type", "c.confidence")


def t_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    q = D.quality(F.col("text"), {c: F.col(c) for c in ("lang", "source", "document_type", "effective_date")}, F.lit(1), F.lit(0))
    return d.select("doc_id", q.alias("q")).select("doc_id", "q.verdict", "q.score")


def t_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.metadata(table(spark, sf_dir, "documents"))


def t_without_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "retrieval_candidate").select(F.col("id").alias("doc_id"), "text").distinct()
    return D.without_furniture(d).select("doc_id", F.length("text").cast("long").alias("length"), "removed_lines")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("key"))
    return ev.partition_offsets(e, "key", 4, "event_id")


def _committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_nationkey < 3")
    return n.select(F.lit("readers").alias("group"), F.col("n_nationkey").cast("int").alias("partition"), (F.col("n_nationkey") * 10).cast("long").alias("offset"))


def k_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.lag(_log(spark, sf_dir), _committed(spark, sf_dir), ["readers", "others"])


def k_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.replay(_log(spark, sf_dir), partition=1, start=100).select("event_id", "key", "offset")


def k_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.poll(_log(spark, sf_dir), _committed(spark, sf_dir), "readers", 25).select("event_id", "partition", "offset")


def r_tenant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "retrieval_candidate").select("query_id", "id", "tenant_id").distinct()
    own = c.groupBy("query_id").agg(F.min("tenant_id").alias("tenant_id"))
    return retrieval.tenant_check(c, own)[1]


def r_bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of one source's referrals only."""
    d = retrieval.filtered(table(spark, sf_dir, "documents"), lang=["en"], document_type="referral")
    q = table(spark, sf_dir, "eval_item").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return retrieval.bm25(d, q, k=3)


def r_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "retrieval_candidate").groupBy("query_id").agg(F.avg("fused_score").alias("fused"), F.max("rerank_score").alias("best"), F.max(F.col("page_end").cast("double")).alias("latency"))
    return retrieval.evaluation_summary(cases.where("latency is not null"), ["fused", "best"], "latency")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("start"), F.concat(F.lit("r"), "n_regionkey").alias("end"), F.col("n_nationkey").cast("long").alias("seq"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("start"), F.concat(F.lit("n"), "s_nationkey").alias("end"), (F.col("s_suppkey") + 1000).cast("long").alias("seq"))
    return n.unionByName(s).withColumn("confidence", F.lit(0.9)), table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))


def g_best_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, starts = _graph(spark, sf_dir)
    return graph.best_paths(graph.traverse(edges, starts), 30)


def g_node_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.coalesce("document_type", F.lit("none")).alias("label"), "text")
    return graph.node_matches(nodes, "blood pressure of a patient with heart failure")


def g_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entry_points(g_node_matches(spark, sf_dir))


def b_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries by channel and how many are messages of the standard."""
    m = table(spark, sf_dir, "hl7_message")
    ok = F.coalesce(F.col("raw"), F.lit("")).contains("MSH")
    return m.groupBy("channel").agg(F.count("*").alias("deliveries"), F.round(100 * F.avg(ok.cast("double")), 2).alias("reliability"))


QUERIES = {
    f.__name__: f
    for f in (q_template, q_dashboard, q_freshness, p_cohort, s_series_summary, s_longitudinal, s_timeline, c_recency, c_agreement, c_coverage, e_incremental_cursor, e_numeric_cursor, e_statistics, e_run_retention, e_watermarks, e_backoff, x_mapping,
              t_document_type, t_quality, t_metadata, t_without_furniture, k_lag, k_replay, k_poll, r_tenant_check, r_bm25_filtered, r_eval_summary, g_best_paths, g_node_matches, g_entry_points, b_audience)
}

_ASKED = "status NOT IN ('entered-in-error', 'cancelled')"


def _rate(where: str) -> str:
    return f"""SELECT dim_code__display, round(count(*) FILTER (WHERE {_ASKED} AND is_abnormal) / nullif(count(*) FILTER (WHERE {_ASKED}), 0), 6) AS v, count(DISTINCT patient_key) FILTER (WHERE {_ASKED} AND patient_key <> '') AS subjects
FROM (SELECT o.*, coalesce(c.display, 'unknown') AS dim_code__display FROM fact_observation o LEFT JOIN dim_code c USING (code_key)) WHERE {where} GROUP BY ALL"""


def _small(inner: str, key: str) -> str:
    return f"SELECT {key}, CASE WHEN subjects = 0 OR subjects >= 11 THEN v END AS value, subjects, subjects BETWEEN 1 AND 10 AS suppressed, CASE WHEN subjects BETWEEN 1 AND 10 THEN 'small_cell' END AS reason FROM ({inner}) WHERE v IS NOT NULL"


def _type_sql() -> str:
    scores = []
    for k, (name, terms) in enumerate(D.TYPE_EVIDENCE.items()):
        total = " + ".join(f"CASE WHEN contains(low, '{t}') THEN {w} ELSE 0 END + CASE WHEN contains(heads, '{t}') THEN {w / 2} ELSE 0 END" for t, w in terms.items())
        scores.append(f"SELECT doc_id, {k} AS o, '{name}' AS type, ({total})::DOUBLE AS score FROM b")
    return f"""WITH b AS (SELECT doc_id, lower(coalesce(text, '')) AS low, lower(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '{HEADING}') AND length(x) <= 80), ' ')) AS heads FROM documents),
s AS ({' UNION ALL '.join(scores)}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS n, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS second FROM s)
SELECT doc_id, CASE WHEN score >= 4 THEN type ELSE 'unknown' END AS type, round(CASE WHEN score >= 4 THEN 0.5 + 0.5 * (score - second) / score ELSE score / 4 END, 4) AS confidence FROM r WHERE n = 1"""


_DIGEST = "(('0x' || substr(sha256(user_id::VARCHAR), 1, 8))::BIGINT % 4)::INT"
_LOG = f"SELECT event_id, user_id::VARCHAR AS key, {_DIGEST} AS partition, row_number() OVER (PARTITION BY {_DIGEST} ORDER BY event_id) - 1 AS \"offset\" FROM events WHERE user_id IS NOT NULL"
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{3,}}'))"
_MATCH = f"SELECT doc_id AS node, coalesce(document_type, 'none') AS label, len(list_intersect({_WORDS.format('text')}, {_WORDS.format(chr(39) + 'blood pressure of a patient with heart failure' + chr(39))})) AS overlap FROM documents"
_GARBLED = r"(length(text) - length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}]|\p{Cf}|\p{Co}', '', 'g')))"
_REACHED = "SELECT 'r' || n_regionkey AS origin, 'n' || n_nationkey AS node, 1 AS hop, 0.72 AS confidence FROM nation UNION ALL SELECT 'r' || n_regionkey, 's' || s_suppkey, 2, 0.5184 FROM supplier JOIN nation ON s_nationkey = n_nationkey"

SQL = {
    "q_template": _small(_rate("organization_id = 'org:001' AND date_key BETWEEN 20260101 AND 20260630"), "dim_code__display"),
    "q_dashboard": f"""SELECT 'abnormal_result_rate' AS tile, * FROM ({_small(_rate("organization_id = 'org:001'"), 'dim_code__display AS label')}) UNION ALL SELECT 'cohort_patient_count', * FROM ({_small("SELECT CASE WHEN c.cohort_key IS NULL THEN 'unknown' ELSE c.sex END AS label, count(DISTINCT patient_key)::DOUBLE AS v, count(DISTINCT patient_key) FILTER (WHERE patient_key <> '') AS subjects FROM fact_observation o LEFT JOIN dim_cohort c USING (cohort_key) WHERE organization_id = 'org:001' GROUP BY ALL", 'label')})""",
    "q_freshness": "SELECT organization_id, count(*) AS rows, max(load_id) AS last_load, max(date_key) AS last_date FROM fact_observation WHERE organization_id = 'org:001' GROUP BY organization_id",
    "p_cohort": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_or(o_totalprice > 300000) AND NOT bool_or(o_orderstatus = 'P')",
    "s_series_summary": "SELECT l_partkey, arg_min(l_quantity, (l_shipdate::VARCHAR, l_quantity)) AS first, arg_max(l_quantity, (l_shipdate::VARCHAR, l_quantity)) AS last, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS minimum, max(l_quantity) AS maximum, count(*) AS points FROM lineitem GROUP BY l_partkey",
    "s_longitudinal": "SELECT o_custkey, o_orderdate, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_totalprice)::INT AS position FROM orders",
    "s_timeline": """WITH t AS (SELECT organization_id, 0 AS k, 'documents' AS track, doc_id::VARCHAR AS event_id, effective_date AS day FROM documents UNION ALL SELECT DISTINCT organization_id, 1, 'loads', load_id, NULL::DATE FROM fact_observation)
SELECT organization_id, track, event_id, day, CASE WHEN day IS NOT NULL THEN row_number() OVER (PARTITION BY organization_id ORDER BY day NULLS LAST, k, event_id) END::INT AS position FROM t WHERE organization_id IS NOT NULL""",
    "c_recency": "SELECT source, round(coalesce(avg(CASE WHEN effective_date IS NOT NULL THEN (DATE '2026-06-01' - effective_date <= 365)::INT END), 0.5), 4) AS recency FROM documents GROUP BY source",
    "c_agreement": "SELECT organization_id, round(count(DISTINCT document_type) / (SELECT count(DISTINCT document_type) FROM documents), 4) AS agreement FROM documents GROUP BY organization_id",
    "c_coverage": f"SELECT id, round(len(list_intersect({_WORDS.format('section_heading')}, {_WORDS.format('text')})) / nullif(len({_WORDS.format('section_heading')}), 0), 6) AS coverage FROM (SELECT DISTINCT id, section_heading, text FROM retrieval_candidate)",
    "e_incremental_cursor": "SELECT load_id, count(*) AS rows, count(*) FILTER (WHERE date_key >= 20260101) AS recent FROM fact_observation WHERE load_id >= 'load-2026-03' GROUP BY load_id",
    "e_numeric_cursor": "SELECT event_type, count(*) AS rows FROM events WHERE event_id >= 1000 GROUP BY event_type",
    "e_statistics": "SELECT organization_id, count(*) AS rows, count(DISTINCT load_id) AS loads, max(load_id) AS last_load FROM fact_observation WHERE trim(organization_id) <> '' GROUP BY organization_id",
    "e_run_retention": "SELECT o_orderkey AS id, o_orderpriority AS kind, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'succeeded' END AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderstatus <> 'P'), o_orderdate DESC, o_orderkey DESC) <= 50",
    "e_watermarks": "SELECT o_orderpriority AS source, 'orders' AS fact, max(o_orderkey)::BIGINT AS cursor, false AS refused FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderpriority UNION ALL SELECT '9-' || n_nationkey, 'orders', n_nationkey::BIGINT, false FROM nation WHERE n_nationkey < 3",
    "e_backoff": "SELECT n_nationkey::BIGINT AS attempt, CASE WHEN n_nationkey >= 1 THEN round(least(300.0, 0.5 * pow(2.0, n_nationkey - 1))::DOUBLE, 4) END AS seconds FROM nation",
    "x_mapping": """WITH o AS (SELECT o_orderkey, substr(strftime(o_orderdate, '%Y%m%d') || '0930', 1, ((o_orderkey % 5) * 2 + 4)::INT) AS s, substr(o_orderpriority, 1, 1) AS rank, CASE WHEN o_orderkey % 3 = 0 THEN '<0.5' ELSE ' ' || o_orderkey END AS amount, 'Clerk#' || o_custkey AS o_clerk, o_orderstatus AS sx, lower(substr(o_orderpriority, 3, 1)) AS flag FROM orders),
d AS (SELECT *, CASE length(s) WHEN 4 THEN s WHEN 6 THEN s[1:4] || '-' || s[5:6] ELSE s[1:4] || '-' || s[5:6] || '-' || s[7:8] END AS day FROM o),
m AS (SELECT o_orderkey, day, CASE WHEN length(s) < 10 THEN day ELSE day || 'T' || s[9:10] || ':' || CASE WHEN length(s) >= 12 THEN s[11:12] ELSE '00' END || ':00+02:00' END AS moment, CASE WHEN length(s) < 10 THEN day END AS strict, CASE rank WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' END AS level,
 try_cast(trim(amount) AS DOUBLE) AS number, 'Practitioner/' || substr(regexp_replace('c/' || trim(o_clerk), '[^A-Za-z0-9.-]', '-', 'g'), 1, 64) AS clerk, CASE sx WHEN 'F' THEN 'female' WHEN 'O' THEN 'other' ELSE 'unknown' END AS sex, CASE WHEN flag IN ('u', 'h') THEN true WHEN flag = 'l' THEN false END AS yes, trim(amount) AS plain, nullif(upper(trim(flag)), '') AS upper, 'x' AS fixed, trim(flag) AS f FROM d)
SELECT * EXCLUDE (f), array_to_string(list_filter([CASE WHEN strict IS NULL THEN 'strict' END, CASE WHEN level IS NULL THEN 'level' END, CASE WHEN number IS NULL THEN 'number' END, CASE WHEN yes IS NULL AND f <> '' THEN 'yes' END], lambda x: x IS NOT NULL), ',') AS unmapped FROM m""",
    "t_document_type": _type_sql(),
    "t_quality": f"""WITH b AS (SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS chars, coalesce({_GARBLED}, 0) / greatest(length(coalesce(text, '')), 1) AS bad, ((lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (document_type IS NOT NULL)::INT + (effective_date IS NOT NULL)::INT) / 4 AS present FROM documents),
s AS (SELECT *, (3 * least(1.0, chars / 240) + 2 + 3 * greatest(0.0, 1 - bad / 0.02) + present) / 9 AS score FROM b)
SELECT doc_id, CASE WHEN chars < 24 OR bad > 0.02 OR score < 0.6 THEN 'fail' ELSE 'pass' END AS verdict, round(score::DOUBLE, 4) AS score FROM s""",
    "k_lag": f"""WITH e AS (SELECT partition, max("offset") + 1 AS e FROM ({_LOG}) GROUP BY partition), c AS (SELECT e.partition, e.e, g, CASE WHEN g = 'readers' AND e.partition < 3 THEN e.partition * 10 ELSE 0 END AS c FROM e, (VALUES ('readers'), ('others')) v(g))
SELECT g AS "group", partition, c::BIGINT AS committed, e AS "end", (e - c)::BIGINT AS lag FROM c""",
    "k_replay": f'SELECT event_id, key, "offset" FROM ({_LOG}) WHERE partition = 1 AND "offset" >= 100',
    "k_poll": f'SELECT event_id, partition, "offset" FROM ({_LOG}) WHERE "offset" >= CASE WHEN partition < 3 THEN partition * 10 ELSE 0 END AND "offset" < CASE WHEN partition < 3 THEN partition * 10 ELSE 0 END + 25',
    "r_bm25_filtered": OPERATORS["r_bm25_topk"].replace("text IS NOT NULL", "text IS NOT NULL AND lang = 'en' AND document_type = 'referral'").replace("rank <= 5", "rank <= 3"),
    "r_tenant_check": "WITH c AS (SELECT DISTINCT query_id, id, tenant_id FROM retrieval_candidate), o AS (SELECT query_id, min(tenant_id) AS t FROM c GROUP BY query_id) SELECT query_id, count(*) FILTER (WHERE tenant_id IS DISTINCT FROM t OR t IS NULL) AS rejected FROM c JOIN o USING (query_id) GROUP BY query_id",
    "r_eval_summary": "SELECT count(*) AS cases, round(avg(fused), 6) AS fused, round(avg(best), 6) AS best, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95 FROM (SELECT avg(fused_score) AS fused, max(rerank_score) AS best, max(page_end)::DOUBLE AS latency FROM retrieval_candidate GROUP BY query_id) WHERE latency IS NOT NULL",
    "g_best_paths": f"SELECT node, origin, hop, round(confidence, 6)::DOUBLE AS confidence, row_number() OVER (ORDER BY confidence DESC, hop, node)::INT AS rank FROM ({_REACHED}) QUALIFY rank <= 30",
    "g_node_matches": f"SELECT * FROM ({_MATCH}) WHERE overlap > 0",
    "g_entry_points": f"SELECT * FROM (SELECT * FROM ({_MATCH}) WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY overlap DESC, node) <= 2) ORDER BY overlap DESC, label, node LIMIT 6",
    "b_audience": "SELECT channel, count(*) AS deliveries, round(100 * avg((contains(coalesce(raw, ''), 'MSH'))::INT), 2) AS reliability FROM hl7_message GROUP BY channel",
}
