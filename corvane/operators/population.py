"""Populations: shares, segments, measures, cohorts and series of many persons at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prevalence(rows: DataFrame, group: str, person: str, case: Column, minimum: int = 11) -> DataFrame:
    """(group, persons, prevalence): share of persons with at least one case; numerators below ``minimum`` but not 0 are withheld (null)."""
    per = rows.where(F.col(person).isNotNull()).groupBy(group, person).agg(F.max(F.coalesce(case, F.lit(False))).alias("has"))
    r = per.groupBy(group).agg(F.count_if("has").alias("n"), F.count("*").alias("persons"))
    return r.select(group, "persons", F.when((F.col("n") == 0) | (F.col("n") >= minimum), F.round(F.col("n") / F.col("persons"), 4)).alias("prevalence"))


def segment(rows: DataFrame, person: str, item: Column, bounds: tuple[tuple[int, str], ...], lowest: str) -> DataFrame:
    """(segment, persons): persons by their number of different items; the first bound reached counts, else ``lowest``."""
    n = rows.where(F.col(person).isNotNull()).groupBy(person).agg(F.countDistinct(item).alias("n"))
    name = F.when(F.lit(False), lowest)
    for least, label in bounds:
        name = name.when(F.col("n") >= least, label)
    return n.groupBy(name.otherwise(lowest).alias("segment")).agg(F.count("*").alias("persons"))


def measure_cascade(persons: DataFrame, group: str, denominator: Column, exclusion: Column, numerator: Column, exception: Column) -> DataFrame:
    """(group, population, denominator, exclusions, numerator, exceptions, rate): each step only sees who passed the ones before.

    An exception counts only outside the numerator. The rate is null without anyone left in the denominator.
    """
    true = lambda c: F.coalesce(c, F.lit(False))
    den = true(denominator)
    exc = den & true(exclusion)
    num = den & ~exc & true(numerator)
    out = den & ~exc & ~num & true(exception)
    g = persons.groupBy(group).agg(F.count("*").alias("population"), F.count_if(den).alias("denominator"), F.count_if(exc).alias("exclusions"), F.count_if(num).alias("numerator"), F.count_if(out).alias("exceptions"))
    return g.withColumn("rate", F.round(F.col("numerator") / F.nullif(F.col("denominator") - F.col("exclusions") - F.col("exceptions"), F.lit(0)), 4))


def cohort(rows: DataFrame, person: str, include: Column, exclude: Column) -> DataFrame:
    """(person): persons with a row that is included and none that is excluded. Null persons are left out."""
    flags = rows.where(F.col(person).isNotNull()).groupBy(person).agg(F.max(F.coalesce(include, F.lit(False))).alias("_in"), F.max(F.coalesce(exclude, F.lit(False))).alias("_out"))
    return flags.where("_in and not _out").select(person)


def series_summary(rows: DataFrame, keys: list[str], when: str, value: str) -> DataFrame:
    """(keys…, first, last, mean, minimum, maximum, points): values in order of (time as text, value); null values and times are left out."""
    r = rows.where(F.col(when).isNotNull() & F.col(value).isNotNull())
    order = F.struct(F.col(when).cast("string").alias("t"), F.col(value).alias("v"))
    return r.groupBy(*keys).agg(F.min(order).alias("a"), F.max(order).alias("b"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.count("*").alias("points")).select(*keys, F.col("a.v").alias("first"), F.col("b.v").alias("last"), "mean", "minimum", "maximum", "points")


def longitudinal(rows: DataFrame, keys: list[str], when: str, value: str) -> DataFrame:
    """``rows`` of a series numbered from 1 in order of (time, value), those without time first."""
    w = Window.partitionBy(*keys).orderBy(F.col(when).asc_nulls_first(), value)
    return rows.where(F.col(value).isNotNull()).select(*keys, when, value, F.row_number().over(w).alias("position"))


def timeline(tracks: dict[str, DataFrame], person: str) -> DataFrame:
    """(person, track, event_id, day, position): the events of all tracks in order of (day, track as given, id); undated ones last, without position.

    Each track has person, event_id and day.
    """
    rows = None
    for k, (name, t) in enumerate(tracks.items()):
        one = t.select(person, F.lit(k).alias("_k"), F.lit(name).alias("track"), F.col("event_id").cast("string").alias("event_id"), F.col("day").cast("date").alias("day"))
        rows = one if rows is None else rows.unionByName(one)
    w = Window.partitionBy(person).orderBy(F.col("day").asc_nulls_last(), "_k", "event_id")
    return rows.where(F.col(person).isNotNull()).withColumn("position", F.when(F.col("day").isNotNull(), F.row_number().over(w))).drop("_k")


def recency(rows: DataFrame, group: str, day: str, now: Column, days: int = 365) -> DataFrame:
    """(group, recency): share of dated rows at most ``days`` old; 0.5 if none is dated."""
    fresh = F.avg(F.when(F.col(day).isNotNull(), (F.datediff(now, F.col(day)) <= days).cast("double")))
    return rows.groupBy(group).agg(F.round(F.coalesce(fresh, F.lit(0.5)), 4).alias("recency"))


def agreement(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, agreement): distinct kinds of source of a group over all kinds there are; null kinds don't count."""
    every = rows.agg(F.countDistinct(kind)).first()[0]  # one number
    return rows.groupBy(group).agg(F.round(F.countDistinct(kind) / F.nullif(F.lit(every), F.lit(0)), 4).alias("agreement"))


def histogram(rows: DataFrame, group: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """(group, le_…, n): cumulative counts of values up to each bound, and of all rows."""
    return rows.groupBy(group).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{b}") for b in bounds], F.count("*").alias("n"))
