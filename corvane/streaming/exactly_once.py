"""Exactly one copy of messages that were delivered at least once.

Two Structured Streaming queries. The first reads identifiers from new deliveries and appends them to an
arrival log; repetitions within one Arrow batch are settled there, so that a hot identifier is one row per
batch afterwards. The second keeps the identifiers seen, one entry each, in Spark's keyed state store and lets
through one copy of each; entries leave the state when the event-time watermark passes them by the horizon.
Offsets, state and output of each query commit together through its checkpoint and the file sink's log, so a
restarted query neither loses nor repeats a row.

What the state did not let through, and what came in after its entry may have expired, is looked up among the
copies let through, by a join on the keys of these arrivals only: a copy that is earlier by its time of receipt
takes the place of the one let through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.messages import identify
from ..session import fresh_path, materialize

_ROW = "key string, received long, delivery long, kind string"
#: Stands for a missing time of receipt, before all others.
_NEVER = -62_135_596_800_000_000


def _settle_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per Arrow batch the earliest copy of each identifier is a candidate; the others are surplus already."""
    for pdf in batches:
        pdf = pdf.sort_values(["received", "delivery"], kind="stable").drop_duplicates(["key", "delivery"])  # a repeated row isn't a second delivery
        yield pdf.assign(kind=np.where(pdf.duplicated("key"), "surplus", "candidate"))[["key", "received", "delivery", "kind"]]


def _run(stream: DataFrame, out: str, checkpoint: str) -> None:
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(out).awaitTermination()


def deduplicate_stream(
    spark: SparkSession, path: str, mapping: DataFrame, *, out: str | None = None, checkpoint: str | None = None,
    horizon: int = 400 * 86_400, files_per_trigger: int | None = None,
) -> DataFrame:
    """(delivery_id, key, kind) of all deliveries with an identifier in the Parquet files at ``path``; kind is ``first`` or ``surplus``.

    Of each identifier, the copy first by received_at, then delivery_id, is ``first``. ``horizon`` is how many
    seconds of event time the state remembers an identifier; later and earlier copies are looked up among those
    let through, so no copy is lost or kept twice, whatever the order or split of files. Rows with a null
    received_at come before all others. Messages without header or identifier are left out; a repeated row of one
    delivery counts once. Running it again with the same ``out`` and ``checkpoint`` takes up new files only.
    """
    base = fresh_path(spark, "seen")
    out, checkpoint = out or f"{base}/out", checkpoint or f"{base}/checkpoint"
    arrivals, passed = f"{out}/arrivals", f"{out}/passed"

    def reader(schema):
        r = spark.readStream.schema(schema)
        return r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r

    # as a pattern, the path may also be a single file
    source = reader(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]").select("delivery_id", "received_at", "raw")
    known = identify(source, mapping).where(F.col("identifier").isNotNull() & F.col("delivery_id").isNotNull())
    rows = known.select(
        F.to_json(F.struct("message_type", "facility", "identifier")).alias("key"),
        F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(_NEVER)).alias("received"), F.col("delivery_id").cast("long").alias("delivery"),
    )
    _run(rows.mapInPandas(_settle_batch, _ROW), arrivals, f"{checkpoint}/arrivals")
    candidates = reader(_ROW).parquet(arrivals).where("kind = 'candidate'")
    timed = candidates.withColumn("at", F.timestamp_micros("received")).withWatermark("at", f"{horizon} seconds")
    _run(timed.dropDuplicatesWithinWatermark(["key"]).select("key", "received", "delivery"), passed, f"{checkpoint}/passed")

    log, accepted = spark.read.schema(_ROW).parquet(arrivals), spark.read.schema("key string, received long, delivery long").parquet(passed)
    # an identifier passes twice only if its copies lie the horizon apart, so no earlier than that after the first of all
    oldest = accepted.agg(F.min("received")).first()[0]
    again = accepted.where(F.col("received") >= F.lit(oldest if oldest is None else oldest + horizon * 1_000_000))
    held_back = log.where("kind = 'candidate'").drop("kind").join(accepted.select("delivery", "key"), ["delivery", "key"], "left_anti")
    asked = materialize(held_back.select("key", "received", "delivery").union(again.select("key", "received", "delivery")), "asked")
    keys = asked.select("key").distinct()
    contested = asked.union(accepted.join(keys, "key", "left_semi").select("key", "received", "delivery"))
    kept = contested.groupBy("key").agg(F.min(F.struct("received", "delivery")).alias("kept"))
    settled = contested.join(kept, "key").select(F.col("delivery").alias("delivery_id"), "key", F.when(F.col("delivery") == F.col("kept.delivery"), "first").otherwise("surplus").alias("kind"))
    alone = accepted.join(keys, "key", "left_anti").select(F.col("delivery").alias("delivery_id"), "key", F.lit("first").alias("kind"))
    surplus = log.where("kind = 'surplus'").select(F.col("delivery").alias("delivery_id"), "key", "kind")
    return settled.distinct().unionByName(alone.distinct()).unionByName(surplus.distinct()).distinct()


def surplus_deliveries(spark: SparkSession, path: str, mapping: DataFrame) -> DataFrame:
    """(delivery_id): every delivery of a message but the first."""
    return deduplicate_stream(spark, path, mapping).where("kind = 'surplus'").select("delivery_id").distinct()
