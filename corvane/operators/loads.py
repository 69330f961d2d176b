"""Incremental loads: cursors, duplicates by natural key, reports of loads, retention of runs, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once_per_key(rows: DataFrame, key: str, load: str) -> DataFrame:
    """(key, load, loads): each natural key with its earliest load and how often it came. Null keys are rejected."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(load).alias(load), F.count("*").alias("loads"))


def load_report(rows: DataFrame, key: str, load: str) -> DataFrame:
    """(load, received, loaded, duplicates): rows of each load that came first for their key, and those that came again."""
    first = rows.groupBy(key).agg(F.min(load).alias("_first"))
    j = rows.join(first, key)
    return j.groupBy(load).agg(F.count("*").alias("received"), F.count_if(F.col(load) == F.col("_first")).alias("loaded"), F.count_if(F.col(load) != F.col("_first")).alias("duplicates"))


def after_cursor(rows: DataFrame, column: str, cursor: str | None, numeric: bool = False) -> DataFrame:
    """Rows at or after a cursor, compared as numbers or as texts; all rows without a cursor. Null and unreadable cursors stay out."""
    if cursor is None:
        return rows
    return rows.where(F.col(column).try_cast("double") >= float(cursor)) if numeric else rows.where(F.col(column).cast("string") >= cursor)


def advance(watermarks: DataFrame, runs: DataFrame, reset: bool = False) -> DataFrame:
    """(source, fact, cursor, refused) after runs (source, fact, cursor, status): the largest cursor of complete and partial runs.

    Failed runs don't count. A cursor below the held one is refused unless ``reset``; then it takes its place.
    """
    new = runs.where("status in ('succeeded', 'partial')").groupBy("source", "fact").agg(F.max("cursor").alias("_new"))
    j = watermarks.select("source", "fact", "cursor").join(new, ["source", "fact"], "full")
    back = F.coalesce(F.col("_new") < F.col("cursor"), F.lit(False))
    value = F.coalesce("_new", "cursor") if reset else F.when(back, F.col("cursor")).otherwise(F.coalesce("_new", "cursor"))
    return j.select("source", "fact", value.alias("cursor"), (back & F.lit(not reset)).alias("refused"))


def retain(runs: DataFrame, keep: int, by: str | None = None) -> DataFrame:
    """The ``keep`` runs to retain (per ``by``): failed ones first, then the newest by (finished, id)."""
    w = Window.partitionBy(*([by] if by else [])).orderBy(F.when(F.col("status") == "failed", 0).otherwise(1), F.desc("finished"), F.desc("id"))
    return runs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def backoff(attempt: Column, initial: float, factor: float, longest: float) -> Column:
    """Seconds before a retry: grows by ``factor`` from ``initial`` up to ``longest``; null below the first attempt."""
    return F.when(attempt >= 1, F.least(F.lit(float(longest)), F.lit(float(initial)) * F.pow(F.lit(float(factor)), attempt - 1)))


def statistics(rows: DataFrame, tenant: str, load: str) -> DataFrame:
    """(tenant, rows, loads, last_load): the rows and loads of each tenant that is not blank."""
    return rows.where(F.trim(tenant) != "").groupBy(tenant).agg(F.count("*").alias("rows"), F.countDistinct(load).alias("loads"), F.max(load).alias("last_load"))
