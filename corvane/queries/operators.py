"""Queries of the text, retrieval, linkage, graph, series and stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..functions.deidentify import age_band, cohort_prefix, pseudonym
from ..operators import graph, loads, population, retrieval, series
from ..operators.linkage import pair_scores
from ..session import table
from ..streaming import events as ev

# --- text


def t_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where("text is not null").select(F.explode(text.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def t_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def t_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.language(F.col("text")).alias("detected"))


def t_personal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "retrieval_candidate").select("id", "text").distinct()
    return d.select("id", F.array_join(text.personal_flags(F.col("text")), ",").alias("flags"))


def t_normalised_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "retrieval_candidate").select("id", "text").distinct()
    return d.select("id", F.length(text.normalise(F.col("text"))).cast("long").alias("length"))


def t_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.exact_copies(table(spark, sf_dir, "documents"))


def t_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.headings(table(spark, sf_dir, "documents"))


def t_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.furniture(table(spark, sf_dir, "retrieval_candidate").select(F.col("id").alias("doc_id"), "text").distinct())


def t_garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "retrieval_candidate").select("id", "text").distinct()
    return d.select("id", text.garbled(F.col("text")).alias("garbled"), (F.length("text") - F.length(F.regexp_replace("text", r"\s", ""))).cast("long").alias("blanks"))


# --- retrieval


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_item").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def r_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), k=5)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return v, v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")


def r_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return retrieval.vector_top_k(v, q, k=10)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "retrieval_candidate").select("query_id", "id", "scores", "ranks", "text", "fused_score", "effective_date").dropDuplicates(["query_id", "id"])


def r_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir).select("query_id", "id", F.explode("ranks").alias("strategy", "rank"))
    one = {s: c.where(F.col("strategy") == s).select("query_id", F.col("id").alias("doc_id"), "rank") for s in ("keyword", "vector", "graph")}
    return retrieval.fuse(one).select("query_id", "doc_id", "fused", F.size("strategies").cast("long").alias("strategies"))


def r_relevance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.above_floor(_candidates(spark, sf_dir)).select("query_id", "id")


def r_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.relative_score(_candidates(spark, sf_dir), F.lit("2026-06-01").cast("date"))


def r_ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    same = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(labels.withColumnRenamed("vec_id", "doc_id"), "label").select("query_id", "doc_id", F.lit(1).alias("gain"))
    return retrieval.rank_metrics(retrieval.vector_top_k(v, q, k=10), same, k=10)


def r_hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.embed(table(spark, sf_dir, "documents"))


def r_context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "id")
    return retrieval.pack_context(_candidates(spark, sf_dir).withColumn("rank", F.row_number().over(w)).select("query_id", "id", "text", "rank"))


# --- linkage


def l_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_scores(table(spark, sf_dir, "field_comparison"))


def l_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "field_comparison").where("left_value <> '' and right_value <> ''").select("left_value", "right_value").distinct()
    return c.select("left_value", "right_value", F.round(similarity.jaro_winkler("left_value", "right_value"), 6).alias("similarity"))


def l_date_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "field_comparison").where("field_name = 'birth_date'").select("left_value", "right_value").distinct()
    a, b = (F.col(x).try_cast("date") for x in ("left_value", "right_value"))
    return c.select("left_value", "right_value", similarity.date_similarity(a, b).alias("similarity"))


# --- graph


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("start"), F.concat(F.lit("r"), "n_regionkey").alias("end"), F.col("n_nationkey").cast("long").alias("seq"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("start"), F.concat(F.lit("n"), "s_nationkey").alias("end"), (F.col("s_suppkey") + 1000).cast("long").alias("seq"))
    return n.unionByName(s).withColumn("confidence", F.lit(0.9))


def g_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("degree"))


def g_bfs_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.traverse(_edges(spark, sf_dir), starts, hops=2)


# --- series, rules, populations


def s_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


def s_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trend(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice")


def s_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), F.col("ts").alias("t"))
    facts = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("k"), F.col("ts").alias("known_at"), F.col("value").alias("v"), F.col("event_id").alias("seq"))
    return series.as_of(points, facts, "k", "t", "known_at", "v", "seq").select("event_id", "feature")


def u_rules_3vl(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "fact_observation")
    high = series.compare(F.col("value"), ">", 100.0, F.col("unit") == "mg/dL")
    rule = series.any_known(series.all_known(high, F.col("is_abnormal")), F.col("status") == "cancelled")
    return o.groupBy("code_key", series.truth(rule).alias("outcome")).agg(F.count("*").alias("n"))


def p_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of persons with at least one abnormal final result per code; small numerators are withheld."""
    return population.prevalence(table(spark, sf_dir, "fact_observation"), "code_key", "patient_key", F.col("is_abnormal") & (F.col("status") == "final"))


def p_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    abnormal = F.when(F.col("is_abnormal"), F.col("code_key"))
    return population.segment(table(spark, sf_dir, "fact_observation"), "patient_key", abnormal, ((6, "complex"), (4, "high"), (2, "rising")), "low")


def p_measure_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population, denominator, exclusions, numerator and exceptions per customer segment."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max((F.col("o_orderstatus") == "P").cast("int")).alias("pending"), F.max((F.col("o_totalprice") > 300000).cast("int")).alias("large"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"))
    f = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return population.measure_cascade(f, "c_mktsegment", F.col("orders") > 0, F.col("pending") == 1, F.col("large") == 1, F.col("urgent") == 0)


# --- loads and streams


def e_deid_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "person_record").dropDuplicates(["record_id"])
    postal = F.get(F.transform("addresses", lambda a: a.postal_code), F.lit(0))
    return p.groupBy(age_band(2026 - F.year("birth_date")).alias("age_band"), cohort_prefix(postal).alias("prefix")).agg(F.count("*").alias("n"))


def e_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", pseudonym(F.col("c_name"), "salt", "cus").alias("pseudonym"))


def e_dedup_natural_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations loaded once: of each key the earliest load, null keys rejected."""
    return loads.once_per_key(table(spark, sf_dir, "fact_observation"), "observation_key", "load_id")


def e_load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.load_report(table(spark, sf_dir, "fact_observation"), "observation_key", "load_id")


def s_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("seq", F.get_json_object("props", "$.k").try_cast("long"))
    return ev.order_violations(e, ["event_type"], "seq", "event_id").select("event_id", "seq", "expected", "violation")


def s_partition_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev.partition_offsets(table(spark, sf_dir, "events"), "event_type", 8, "event_id")
    return e.groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("last"))


def s_sliding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev.sliding_rates(table(spark, sf_dir, "events"), "ts", "value", "6 hours", "3 hours")
    return e.select("window_start", "events", F.round("total", 2).alias("total"))


def s_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets per event type."""
    return population.histogram(table(spark, sf_dir, "events"), "event_type", "value", (1, 5, 10, 50, 100))


def a_audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid chains, one per customer, of which every row with a key divisible by 97 was altered afterwards: these rows are found."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("payload"))
    altered = F.when(F.col("seq") % 97 == 0, F.concat("payload", F.lit(" altered"))).otherwise(F.col("payload"))
    return ev.verify_chain(ev.chained(o, "tenant", "seq").withColumn("payload", altered), "tenant", "seq").select("tenant", "seq")


_NAMES = """t_terms t_token_estimate t_language t_personal_flags t_normalised_length t_exact_copies t_headings t_furniture t_garbled r_bm25_topk r_vector_topk r_rrf r_relevance_floor r_rerank r_ir_metrics
r_hash_embedding r_context_packing l_pair_scores l_jaro_winkler l_date_similarity g_neighbours g_bfs_2hop s_latest s_trend s_as_of u_rules_3vl p_prevalence p_segment p_measure_cascade e_deid_bands e_pseudonyms
e_dedup_natural_key e_load_report s_order_violations s_partition_offsets s_sliding_rates s_histogram a_audit_chain"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_MARK = ", ".join(f"'{w}'" for w in text.ENGLISH_MARKERS)
_ONE = "(SELECT DISTINCT ON (query_id, id) * FROM retrieval_candidate)"
_COS = "SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(greatest(0, least(1, (list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) + 1) / 2)), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0"
_TOP = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM ({_COS}) QUALIFY rank <= 10"
_TERMS = r"list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[./-][a-z0-9]+)*'), lambda w: w NOT IN ({1}))"



def _normalised_sql() -> str:
    x = "text"
    for source, target in text.TYPOGRAPHIC.items():
        x = "replace({0}, '{1}', '{2}')".format(x, source.replace("'", "''"), target.replace("'", "''"))
    steps = ((r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "''"), (r"\r\n?", "chr(10)"), (r"(\w)-[ \t]*\n\s*([a-z])", r"'\1\2'"), (r"[ \t]{2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)"), (r"(?m)[ \t]+$", "''"))
    for pattern, target in steps:
        x = f"regexp_replace({x}, '{pattern}', {target}, 'g')"
    return f"SELECT id, length(trim({x}, ' ' || chr(10) || chr(9))) AS length FROM (SELECT DISTINCT id, text FROM retrieval_candidate)"


SQL = {
    "t_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TERMS.format('text', _STOP)}) AS term FROM documents) GROUP BY term",
    "t_token_estimate": r"SELECT doc_id, (coalesce(list_sum(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: ceil(length(w) / 4))), 0) + len(regexp_extract_all(text, '[^\p{L}\p{N}_\s]')))::BIGINT AS tokens FROM documents",
    "t_language": f"SELECT doc_id, CASE WHEN len(w) >= 20 AND len(list_filter(w, lambda x: x IN ({_MARK}))) / len(w) >= 0.06 THEN 'en' END AS detected FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)",
    "t_personal_flags": "SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in sorted(text.PERSONAL_PATTERNS.items())) + "], lambda x: x IS NOT NULL), ',') AS flags FROM (SELECT DISTINCT id, text FROM retrieval_candidate)",
    "t_exact_copies": r"WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k FROM documents WHERE text IS NOT NULL) SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS copies FROM d",
    "t_headings": r"""WITH l AS (SELECT doc_id, length(text) AS size, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM l),
h AS (SELECT * FROM p WHERE regexp_matches(trim(line), '^[A-Z][A-Z /&-]{2,}$') AND length(line) <= 80)
SELECT doc_id, position, trim(line) AS heading, (coalesce(lead(position) OVER (PARTITION BY doc_id ORDER BY n), size) - position)::BIGINT AS length FROM h""",
    "r_bm25_topk": f"""WITH d AS (SELECT doc_id, {_TERMS.format('text', _STOP)} AS t FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d),
tf AS (SELECT doc_id, len(any_value(t)) AS n, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format('text', _STOP)}) AS term FROM eval_item) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""",
    "r_vector_topk": _TOP,
    "r_rrf": f"""WITH c AS (SELECT query_id, id, unnest(map_entries(ranks)) AS e FROM {_ONE})
SELECT query_id, id AS doc_id, round(sum(1 / (60 + e.value)), 9) AS fused, count(*) AS strategies FROM c WHERE e.key IN ('keyword', 'vector', 'graph') GROUP BY query_id, id""",
    "r_relevance_floor": f"SELECT query_id, id FROM {_ONE} WHERE len(list_filter(map_values(scores), lambda s: s >= 0.5)) > 0",
    "r_rerank": f"SELECT query_id, id, round((3.0 * fused_score / CASE WHEN m > 0 THEN m ELSE 1 END + 0.5 * CASE WHEN effective_date IS NULL THEN 0.5 ELSE pow(0.5, greatest(DATE '2026-06-01' - effective_date, 0) / 730.0) END) / 3.5, 6) AS score FROM (SELECT *, max(fused_score) OVER (PARTITION BY query_id) AS m FROM {_ONE})",
    "r_ir_metrics": f"""WITH t AS ({_TOP}), g AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id FROM embeddings q JOIN embeddings d USING (label) WHERE q.vec_id % 20 = 0), n AS (SELECT query_id, count(*) AS n FROM g GROUP BY query_id),
h AS (SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM t JOIN g USING (query_id, doc_id)),
p AS (SELECT query_id, count(*) AS h, min(rank) AS first, sum(seen / rank) AS ap, sum(1 / log2(rank + 1)) AS dcg FROM h GROUP BY query_id)
SELECT query_id, round(coalesce(h / 10, 0), 6) AS precision, round(coalesce(h / n, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(ap / n, 0), 6) AS average_precision,
round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) r(i)), 0), 6) AS ndcg FROM n LEFT JOIN p USING (query_id)""",
    "l_pair_scores": """WITH c AS (SELECT DISTINCT pair_id, field_name, weight, coalesce(nullif(trim(correlation_group), ''), chr(1) || field_name) AS g FROM field_comparison WHERE similarity IS NOT NULL),
s AS (SELECT pair_id, g, arg_max(weight, abs(weight)) AS w FROM c GROUP BY ALL), t AS (SELECT pair_id, round(sum(w), 4) AS score FROM s GROUP BY pair_id),
a AS (SELECT DISTINCT f.pair_id, coalesce(t.score, 0) AS score FROM field_comparison f LEFT JOIN t USING (pair_id))
SELECT pair_id, score, CASE WHEN score >= 16 THEN 'match' WHEN score <= 6 THEN 'non_match' ELSE 'review' END AS score_zone FROM a""",
    "l_jaro_winkler": "SELECT DISTINCT left_value, right_value, round(jaro_similarity(left_value, right_value) + (SELECT coalesce(max(k), 0) FROM range(1, 5) r(k) WHERE k <= least(length(left_value), length(right_value)) AND left_value[1:k] = right_value[1:k]) * 0.1 * (1 - jaro_similarity(left_value, right_value)), 6) AS similarity FROM field_comparison WHERE left_value <> '' AND right_value <> ''",
    "l_date_similarity": """SELECT DISTINCT left_value, right_value, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = b THEN 1.0::DOUBLE WHEN year(a) = year(b) AND month(a) = day(b) AND day(a) = month(b) THEN 0.8::DOUBLE
WHEN (year(a) = year(b) AND month(a) = month(b)) OR (month(a) = month(b) AND day(a) = day(b) AND abs(year(a) - year(b)) = 1) THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END AS similarity
FROM (SELECT left_value, right_value, try_cast(left_value AS DATE) AS a, try_cast(right_value AS DATE) AS b FROM field_comparison WHERE field_name = 'birth_date')""",
    "g_neighbours": "WITH e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier) SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node",
    "g_bfs_2hop": """WITH r AS (SELECT 'r' || r_regionkey AS origin FROM region), n AS (SELECT 'r' || n_regionkey AS origin, 'n' || n_nationkey AS node, n_nationkey FROM nation)
SELECT origin, origin AS node, 0 AS hop, 1.0::DOUBLE AS confidence FROM r UNION ALL SELECT origin, node, 1, 0.72 FROM n JOIN r USING (origin) UNION ALL SELECT origin, 's' || s_suppkey, 2, 0.5184 FROM supplier JOIN n ON s_nationkey = n_nationkey JOIN r USING (origin)""",
    "s_latest": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1",
    "s_trend": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC) AS k FROM orders QUALIFY k <= 5),
s AS (SELECT o_custkey, count(*) AS points, arg_max(o_totalprice, k) AS first, arg_min(o_totalprice, k) AS last FROM n GROUP BY o_custkey)
SELECT *, CASE WHEN points < 2 THEN 'unknown' WHEN abs(last - first) <= 0.05 * abs(first) THEN 'stable' WHEN last > first THEN 'rising' ELSE 'falling' END AS trend FROM s""",
    "s_as_of": "SELECT p.event_id, (SELECT f.value FROM events f WHERE f.event_type = 'purchase' AND f.user_id = p.user_id AND f.ts <= p.ts ORDER BY f.ts DESC, f.event_id DESC LIMIT 1) AS feature FROM events p",
    "u_rules_3vl": """SELECT code_key, CASE WHEN r IS NULL THEN 'unknown' WHEN r THEN 'true' ELSE 'false' END AS outcome, count(*) AS n
FROM (SELECT code_key, ((CASE WHEN unit = 'mg/dL' THEN value > 100 END) AND is_abnormal) OR status = 'cancelled' AS r FROM fact_observation) GROUP BY ALL""",
    "p_prevalence": """WITH p AS (SELECT code_key, patient_key, bool_or(coalesce(is_abnormal AND status = 'final', false)) AS has FROM fact_observation WHERE patient_key IS NOT NULL GROUP BY ALL),
r AS (SELECT code_key, count(*) FILTER (WHERE has) AS n, count(*) AS persons FROM p GROUP BY code_key) SELECT code_key, persons, CASE WHEN n = 0 OR n >= 11 THEN round(n / persons, 4) END AS prevalence FROM r""",
    "p_segment": "SELECT CASE WHEN n >= 6 THEN 'complex' WHEN n >= 4 THEN 'high' WHEN n >= 2 THEN 'rising' ELSE 'low' END AS segment, count(*) AS persons FROM (SELECT patient_key, count(DISTINCT code_key) FILTER (WHERE is_abnormal) AS n FROM fact_observation WHERE patient_key IS NOT NULL GROUP BY patient_key) GROUP BY 1",
    "p_measure_cascade": """WITH o AS (SELECT o_custkey, count(*) AS orders, bool_or(o_orderstatus = 'P') AS pending, bool_or(o_totalprice > 300000) AS large, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_custkey),
f AS (SELECT c_mktsegment, coalesce(orders > 0, false) AS den, coalesce(pending, false) AS exc, coalesce(NOT pending AND large, false) AS num, coalesce(NOT pending AND NOT large AND NOT urgent, false) AS ex2 FROM customer LEFT JOIN o ON c_custkey = o_custkey),
g AS (SELECT c_mktsegment, count(*) AS population, count(*) FILTER (WHERE den) AS denominator, count(*) FILTER (WHERE exc) AS exclusions, count(*) FILTER (WHERE num) AS numerator, count(*) FILTER (WHERE ex2) AS exceptions FROM f GROUP BY c_mktsegment)
SELECT *, round(numerator / nullif(denominator - exclusions - exceptions, 0), 4) AS rate FROM g""",
    "e_deid_bands": r"""WITH p AS (SELECT DISTINCT ON (record_id) record_id, 2026 - year(birth_date) AS age, regexp_replace(coalesce(addresses[1].postal_code, ''), '[^0-9]', '', 'g') AS z FROM person_record)
SELECT CASE WHEN age IS NULL OR age < 0 THEN 'unknown' WHEN age >= 90 THEN '90+' ELSE (age // 5 * 5)::VARCHAR || '-' || (age // 5 * 5 + 4)::VARCHAR END AS age_band,
CASE WHEN z = '' THEN 'unknown' WHEN substr(z, 1, 3) IN ('036', '059', '102', '202', '203', '204', '205', '369', '556', '692', '753', '772', '821', '823', '878', '879', '884', '893') THEN 'suppressed' ELSE substr(z, 1, 3) END AS prefix, count(*) AS n FROM p GROUP BY ALL""",
    "e_pseudonyms": "SELECT c_custkey, 'cus_' || substr(sha256('salt|' || c_name), 1, 32) AS pseudonym FROM customer",
    "e_dedup_natural_key": "SELECT observation_key, min(load_id) AS load_id, count(*) AS loads FROM fact_observation WHERE observation_key IS NOT NULL GROUP BY observation_key",
    "e_load_report": "SELECT load_id, count(*) AS received, count(*) FILTER (WHERE load_id = f) AS loaded, count(*) FILTER (WHERE load_id <> f) AS duplicates FROM (SELECT *, min(load_id) OVER (PARTITION BY observation_key) AS f FROM fact_observation) GROUP BY load_id",
    "s_order_violations": """WITH e AS (SELECT event_id, event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS seq FROM events), x AS (SELECT *, max(seq) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS expected FROM e WHERE seq IS NOT NULL)
SELECT event_id, seq, expected, CASE WHEN seq > expected THEN 'gap' ELSE 'regression' END AS violation FROM x WHERE seq <> expected""",
    "s_sliding_rates": "WITH w AS (SELECT time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR * i AS window_start, value FROM events, range(0, 2) r(i)) SELECT window_start, count(*) AS events, round(sum(value), 2) AS total FROM w GROUP BY window_start",
    "s_histogram": "SELECT event_type, " + ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS le_{b}" for b in (1, 5, 10, 50, 100)) + ", count(*) AS n FROM events GROUP BY event_type",
    "a_audit_chain": "SELECT o_custkey AS tenant, o_orderkey AS seq FROM orders WHERE o_orderkey % 97 = 0",
    "t_normalised_length": _normalised_sql(),
    "t_garbled": r"SELECT id, (length(text) - length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}]|\p{Cf}|\p{Co}', '', 'g')))::BIGINT AS garbled, (length(text) - length(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g')))::BIGINT AS blanks FROM (SELECT DISTINCT id, text FROM retrieval_candidate)",
    "s_partition_offsets": "SELECT (('0x' || substr(sha256(event_type), 1, 8))::BIGINT % 8)::INT AS partition, count(*) AS n, count(*) - 1 AS last FROM events WHERE event_type IS NOT NULL GROUP BY 1",
}
