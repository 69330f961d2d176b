"""Queries over JSON resources, chunks and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import chunk, sentence_count
from ..operators import evidence as E
from ..operators import resources as R
from ..session import table


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.read_resources(table(spark, sf_dir, "bulk_import_line").where("line_format = 'ndjson'"))


def v_resource_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resources(spark, sf_dir).groupBy("resource_type", R.path("status").alias("status")).agg(F.count("*").alias("n"))


def v_search_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of final glucose observations of a year, with their values."""
    hits = R.search(_resources(spark, sf_dir), "Observation", count=50, status="final", date="2026")
    return hits.select("id", R.path("code.coding.0.code").alias("code"), R.path("valueQuantity.value", "double").alias("value"))


def v_compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.compartments(_resources(spark, sf_dir))


def t_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(table(spark, sf_dir, "documents"))


def t_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sentence_count(F.col("text")).alias("sentences"))


def c_evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "retrieval_candidate").where("text is not null").select("query_id", "id", "text", "fused_score")
    return E.deduplicate(rows, "text", [F.desc("fused_score"), F.col("id"), F.col("query_id")]).select("id", "query_id")


def c_corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.corroborated(table(spark, sf_dir, "retrieval_candidate"), "query_id", "source_system", "text")


def x_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(E.bucket(F.col("c_custkey"), "rollout", 10).alias("bucket")).agg(F.count("*").alias("n"))


def x_claim_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer, due a thousand days after the first day: a ranked report of fifty."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("partition"), F.col("o_orderkey").alias("sequence"), F.col("o_orderdate").alias("due_at"))
    return E.claim_heads(o, F.lit("1997-01-01").cast("timestamp"), 50).select("partition", "sequence")


QUERIES = {f.__name__: f for f in (v_resource_types, v_search_final, v_compartments, t_chunks, t_sentences, c_evidence_dedup, c_corroborated, x_buckets, x_claim_heads)}
_RES = "(SELECT DISTINCT line AS j FROM bulk_import_line WHERE line_format = 'ndjson' AND json_valid(line) AND json_type(CASE WHEN json_valid(line) THEN line END) = 'OBJECT' AND coalesce(json_extract_string(CASE WHEN json_valid(line) THEN line END, '$.id'), '') <> '' AND coalesce(json_extract_string(CASE WHEN json_valid(line) THEN line END, '$.resourceType'), '') <> '')"
SQL = {
    "v_resource_types": f"SELECT j->>'$.resourceType' AS resource_type, j->>'$.status' AS status, count(*) AS n FROM {_RES} GROUP BY ALL",
    "v_search_final": f"SELECT j->>'$.id' AS id, j->>'$.code.coding[0].code' AS code, try_cast(j->>'$.valueQuantity.value' AS DOUBLE) AS value FROM {_RES} WHERE j->>'$.resourceType' = 'Observation' AND j->>'$.status' = 'final' AND (j->>'$.effectiveDateTime') LIKE '2026%' ORDER BY 1 LIMIT 50",
    "v_compartments": f"SELECT subject, resource_type, count(*) AS resources FROM (SELECT 'Patient/' || (j->>'$.id') AS subject, 'Patient' AS resource_type FROM {_RES} WHERE j->>'$.resourceType' = 'Patient' UNION ALL SELECT j->>'$.subject.reference', j->>'$.resourceType' FROM {_RES} WHERE (j->>'$.subject.reference') IS NOT NULL) GROUP BY ALL",
    "c_evidence_dedup": r"SELECT id, query_id FROM retrieval_candidate WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY fused_score DESC, id, query_id) = 1",
    "c_corroborated": r"SELECT query_id, number, count(*) AS kinds FROM (SELECT DISTINCT query_id, source_system, unnest(regexp_extract_all(text, '\d+(?:\.\d+)?')) AS number FROM retrieval_candidate) GROUP BY ALL HAVING count(*) > 1",
    "x_buckets": "SELECT ('0x' || substr(sha256('rollout:' || c_custkey::VARCHAR), 1, 8))::BIGINT % 10 AS bucket, count(*) AS n FROM customer GROUP BY 1",
    "x_claim_heads": "SELECT partition, sequence FROM (SELECT o_custkey AS partition, o_orderkey AS sequence, o_orderdate AS due_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) WHERE due_at <= TIMESTAMP '1997-01-01' ORDER BY due_at, partition, sequence LIMIT 50",
}
