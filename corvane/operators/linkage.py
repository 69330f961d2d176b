"""Scores of compared record pairs from the weights of their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import zone


def pair_scores(comparisons: DataFrame) -> DataFrame:
    """(pair_id, score, score_zone): weights summed per pair, of a correlated group only the strongest by magnitude.

    Two such fields show one fact, for example a shared household. Fields with a null similarity count nothing; a pair of
    only such fields scores 0. Repeated rows of a field count once.
    """
    c = comparisons.where("similarity is not null").select("pair_id", "field_name", "weight", F.nullif(F.trim("correlation_group"), F.lit("")).alias("g")).distinct()
    strongest = c.groupBy("pair_id", F.coalesce("g", F.concat(F.lit("\x00"), F.col("field_name"))).alias("g")).agg(F.max_by("weight", F.struct(F.abs("weight"), F.col("weight"))).alias("w"))
    total = strongest.groupBy("pair_id").agg(F.round(F.sum("w"), 4).alias("score"))
    every = comparisons.select("pair_id").distinct().join(total, "pair_id", "left")
    return every.select("pair_id", F.coalesce("score", F.lit(0.0)).alias("score"), zone(F.coalesce("score", F.lit(0.0))).alias("score_zone"))


def identifier_conflicts(identifiers: DataFrame, holder: str) -> DataFrame:
    """(system, value, holders): identifiers that more than one holder has. Null and empty values and null holders are left out."""
    rows = identifiers.where(F.col(holder).isNotNull() & (F.col("value") != "")).select(holder, "system", "value").distinct()
    return rows.groupBy("system", "value").agg(F.count("*").alias("holders")).where("holders > 1")
