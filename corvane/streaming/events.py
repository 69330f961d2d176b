"""Operators over event streams, usable on static and streaming DataFrames where stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def in_ranges(rows: DataFrame, order: str, label: str = "ranges") -> DataFrame:
    """``rows`` with ``_range``, ascending ranges of ``order`` of about equal size, so that windows over a hot key run range by range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return materialize(rows.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), label)


def order_violations(events: DataFrame, keys: list[str], sequence: str, arrival: str) -> DataFrame:
    """Events whose sequence isn't the key's running maximum plus one: ``gap`` beyond it, ``regression`` at or below it.

    The first event of a key starts it. A null sequence violates nothing. Static only. ``arrival`` is different for each
    event of a key. A key's events are spread over ranges of arrival; the maximum of earlier ranges is joined to each.
    """
    rows = in_ranges(events.where(F.col(sequence).isNotNull()), arrival)
    w = Window.partitionBy(*keys, "_range").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, "_range").agg(F.max(sequence).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = tops.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.max("_top").over(earlier).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]) & (F.col("_range") == F.col("_r"))
    top = rows.join(before, same).withColumn("expected", F.greatest(F.max(sequence).over(w), F.col("_before")) + 1)
    kind = F.when(F.col(sequence) > F.col("expected"), "gap").when(F.col(sequence) < F.col("expected"), "regression")
    return top.withColumn("violation", kind).where("violation is not null").select(*events.columns, "expected", "violation")


def partition_of(key: Column, partitions: int) -> Column:
    """The partition of a key: the first eight hexadecimal digits of its SHA-256 digest, modulo the number of partitions."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(partitions)).cast("int")


def partition_offsets(events: DataFrame, key: str, partitions: int, arrival: str) -> DataFrame:
    """``events`` with partition and dense offset in arrival order. A null key is refused by leaving its rows out.

    A partition's events are numbered range by range of arrival, after the counts of earlier ranges.
    """
    rows = in_ranges(events.where(F.col(key).isNotNull()).withColumn("partition", partition_of(F.col(key), partitions)), arrival)
    sizes = rows.groupBy("partition", "_range").count()
    earlier = Window.partitionBy("partition").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("partition", "_range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("partition", "_range").orderBy(arrival)) - 1
    return rows.join(base, ["partition", "_range"]).withColumn("offset", (own + F.col("_base")).cast("long")).select(*events.columns, "partition", "offset")


def sliding_rates(events: DataFrame, at: str, value: str, length: str = "5 minutes", slide: str = "1 minute", delay: str | None = None) -> DataFrame:
    """(window_start, events, total) per sliding window; static or streaming, there with a watermark of ``delay``."""
    e = events.withWatermark(at, delay) if delay else events
    return e.groupBy(F.window(at, length, slide)).agg(F.count("*").alias("events"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), "events", "total")


def first_delivery(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """One event per id within the watermark; streaming."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def verify_chain(rows: DataFrame, tenant: str, order: str, hash_column: str = "row_hash", previous: str = "previous_hash", payload: str = "payload") -> DataFrame:
    """Rows of an audit chain that break it: their hash isn't that of payload and predecessor, or the predecessor's hash differs.

    The predecessor is found by its place in the tenant's order, numbered range by range, so that no task holds a tenant.
    """
    ranged = in_ranges(rows, order)
    within = Window.partitionBy(tenant, "_range").orderBy(order)
    last = ranged.groupBy(tenant, "_range").agg(F.max_by(hash_column, order).alias("_last"))
    carried = last.select(F.col(tenant).alias("_t"), F.col("_range").alias("_r"), F.lag("_last").over(Window.partitionBy(tenant).orderBy("_range")).alias("_carried"))
    j = ranged.join(carried, ranged[tenant].eqNullSafe(F.col("_t")) & (F.col("_range") == F.col("_r")))
    before = F.coalesce(F.lag(hash_column).over(within), F.col("_carried"), F.lit(""))
    own = F.sha2(F.concat_ws("|", F.col(previous), F.col(payload)), 256)
    return j.withColumn("_b", before).where((F.col("_b") != F.col(previous)) | (own != F.col(hash_column))).select(*rows.columns)


def chained(rows: DataFrame, tenant: str, order: str, payload: str = "payload") -> DataFrame:
    """(tenant, order, payload, previous_hash, row_hash): a valid chain per tenant, for tenants whose rows fit a task."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(payload).alias("p"))))
    link = lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat_ws("|", F.element_at(acc, -1), x.p), 256)))
    g = rows.groupBy(tenant).agg(sorted_rows.alias("_r")).withColumn("_h", F.aggregate("_r", F.array(F.lit("")), link))
    one = g.select(tenant, F.posexplode("_r").alias("_n", "_x"), "_h")
    return one.select(tenant, F.col("_x.o").alias(order), F.col("_x.p").alias(payload), F.get("_h", F.col("_n")).alias("previous_hash"), F.get("_h", F.col("_n") + 1).alias("row_hash"))
