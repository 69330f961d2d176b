"""A partitioned log as a table (partition, offset, key, …): replay and the progress of consumer groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(log: DataFrame, partition: int | None = None, key: str | None = None, start: int = 0, base: int = 0) -> DataFrame:
    """Records from offset ``start`` on, of one partition or key if given, in order; offsets below ``base`` are gone and refused."""
    if start < base:
        raise ValueError(f"offset {start} is before {base}, the first one kept")
    rows = log.where(F.col("offset") >= start)
    if partition is not None:
        rows = rows.where(F.col("partition") == partition)
    if key is not None:
        rows = rows.where(F.col("key") == key)
    return rows.orderBy("partition", "offset")


def commit(committed: DataFrame, positions: DataFrame) -> DataFrame:
    """(group, partition, offset, regressed): the new position of each group, which never goes back."""
    new = positions.groupBy("group", "partition").agg(F.max("offset").alias("_new"))
    j = committed.select("group", "partition", "offset").join(new, ["group", "partition"], "full")
    return j.select("group", "partition", F.greatest("offset", "_new").alias("offset"), F.coalesce(F.col("_new") < F.col("offset"), F.lit(False)).alias("regressed"))


def lag(log: DataFrame, committed: DataFrame, groups: list[str]) -> DataFrame:
    """(group, partition, committed, end, lag): what each of the groups has still to read; a partition that it never read starts at 0."""
    ends = log.groupBy("partition").agg((F.max("offset") + 1).alias("end"))
    return (
        ends.withColumn("group", F.explode(F.array(*map(F.lit, groups)))).join(committed.withColumnRenamed("offset", "committed"), ["group", "partition"], "left")
        .select("group", "partition", F.coalesce("committed", F.lit(0)).cast("long").alias("committed"), "end", (F.col("end") - F.coalesce("committed", F.lit(0))).cast("long").alias("lag"))
    )


def poll(log: DataFrame, committed: DataFrame, group: str, limit: int) -> DataFrame:
    """The next ``limit`` records of each partition for a group, from its committed position on."""
    at = committed.where(F.col("group") == group).select("partition", F.col("offset").alias("_at"))
    rows = log.join(at, "partition", "left").where(F.col("offset") >= F.coalesce("_at", F.lit(0))).drop("_at")
    w = Window.partitionBy("partition").orderBy("offset")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
