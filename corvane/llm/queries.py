"""Queries over training text and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import components, leakage, linkage, mixing, ocr, privacy, reading_level


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.mentions(table(spark, sf_dir, "retrieval_candidate"), table(spark, sf_dir, "person_record"))
    return found.select("id", "category", "start_pos")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.redact(table(spark, sf_dir, "retrieval_candidate"), table(spark, sf_dir, "person_record"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.scanned_faults(table(spark, sf_dir, "retrieval_candidate"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.repair(table(spark, sf_dir, "retrieval_candidate"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.match_records(table(spark, sf_dir, "person_record")).select("record_id_a", "record_id_b")


def p3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.match_records(table(spark, sf_dir, "person_record"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = components.match_links(table(spark, sf_dir, "match_score"))
    return components.connected_components(links, "left_record_id", "right_record_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label")).select("doc_id", "band").distinct()


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.corpus_profile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_repaired, p3_found, p3_confidence, p7_found, p8_found, p9_mixture, p9_shares, p10_found, p10_profile)}
SQL: dict[str, str] = {
    "p7_found": """
WITH RECURSIVE e AS (SELECT left_record_id AS a, right_record_id AS b FROM match_score
    WHERE left_record_id <> right_record_id AND (lower(trim(zone)) = 'match' OR ((zone IS NULL OR trim(zone) = '') AND total >= 16))),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS record_id, a AS other FROM s UNION SELECT r.record_id, s.b FROM r JOIN s ON r.other = s.a)
SELECT record_id, min(other) AS group_id FROM r GROUP BY record_id
""",
}
