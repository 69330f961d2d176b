"""Ordered analysis of observations: latest values, trends, point-in-time features, rules with unknown outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row per key; undated rows come last, and of equal dates the smallest ``tie`` wins."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.col(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def trend(rows: DataFrame, keys: list[str], at: str, value: str, last: int = 5, ratio: float = 0.05) -> DataFrame:
    """(keys…, points, first, last, trend) over the last points: stable within ``ratio`` of the first, else rising or falling; unknown for one point."""
    known = rows.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(value).desc())
    near = known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    s = near.groupBy(*keys).agg(F.count("*").alias("points"), F.max_by(value, "_n").alias("first"), F.min_by(value, "_n").alias("last"))
    delta = F.col("last") - F.col("first")
    label = F.when(F.col("points") < 2, "unknown").when(F.abs(delta) <= ratio * F.abs("first"), "stable").when(delta > 0, "rising").otherwise("falling")
    return s.withColumn("trend", label)


def as_of(points: DataFrame, facts: DataFrame, key: str, at: str, known_at: str, value: str, sequence: str) -> DataFrame:
    """``points`` with the value last known at their time; of equal times the later written wins. Points without one get null.

    Both sides are merged into one ordered stream per key, so the work is a sort and not a range join.
    """
    cols = points.columns
    left = points.select(*cols, F.col(at).alias("_t"), F.lit(None).cast(facts.schema[sequence].dataType).alias("_s"), F.lit(1).alias("_side"), F.lit(None).cast(facts.schema[value].dataType).alias("_v"), F.lit(False).alias("_has"))
    right = facts.where(F.col(known_at).isNotNull()).select(*[(F.col(key) if c == key else F.lit(None).cast(points.schema[c].dataType)).alias(c) for c in cols], F.col(known_at).cast(points.schema[at].dataType).alias("_t"), F.col(sequence).alias("_s"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(True).alias("_has"))
    w = Window.partitionBy(key).orderBy("_t", "_side", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumn("_f", F.last(F.when(F.col("_has"), F.struct(F.col("_v").alias("v"))), ignorenulls=True).over(w))
    return both.where("_side = 1").select(*cols, F.col("_f.v").alias("feature"))


def compare(value: Column, operator: str, threshold: float, same_unit: Column | None = None) -> Column:
    """A comparison that is null, unknown, for a missing value or another unit."""
    made = {">": value > threshold, ">=": value >= threshold, "<": value < threshold, "<=": value <= threshold, "==": value == threshold, "!=": value != threshold}[operator]
    return made if same_unit is None else F.when(same_unit, made)


def all_known(*conditions: Column) -> Column:
    """Kleene conjunction: false beats unknown beats true."""
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def any_known(*conditions: Column) -> Column:
    """Kleene disjunction: true beats unknown beats false."""
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def truth(condition: Column) -> Column:
    return F.when(condition.isNull(), "unknown").when(condition, "true").otherwise("false")
