"""Loading and publishing files: incremental loads with committed keys, NDJSON, CSV reports, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object per line with sorted keys; nulls are left out."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.text(path)


def export_with_manifest(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each table as NDJSON below ``path``, and its row counts."""
    spark, counts = next(iter(tables.values())).sparkSession, {}
    for name, df in tables.items():
        write_ndjson(df, f"{path}/{name}")
        counts[name] = spark.read.text(f"{path}/{name}").count()
    spark.createDataFrame([(json.dumps({"counts": counts}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return counts


def write_report(df: DataFrame, path: str, key: str = "suppressed", value: str = "value") -> None:
    """A CSV report; a suppressed value is never written, whatever the column holds."""
    safe = df.withColumn(value, F.when(~F.coalesce(F.col(key), F.lit(False)), F.col(value))) if key in df.columns else df
    safe.write.option("header", True).csv(path)


def upsert_dimension(old: DataFrame | None, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last written of old and new rows; old rows lose against new ones."""
    rows = new.withColumn("_age", F.lit(1))
    if old is not None:
        rows = rows.unionByName(old.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("_age"), F.col(order).desc_nulls_last())
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_age")


class IncrementalLoader:
    """Loads records whose natural key isn't committed yet.

    A batch is identified by its id: loading the same batch again changes nothing, because its folder is replaced as a
    whole. Keys count as seen only once committed, so a failed load can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def committed(self, before: int | None = None) -> DataFrame | None:
        """What is loaded, without the batch ``before`` itself."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        df = self.spark.read.parquet(self.path)
        return df if before is None else df.where(F.col("batch") != before)

    def load(self, records: DataFrame, batch: int, order: str) -> dict[str, int]:
        """Counters of a batch: received, rejected (a null key), duplicates, loaded."""
        received = records.count()
        good = records.where(" and ".join(f"{k} is not null" for k in self.keys))
        w = Window.partitionBy(*self.keys).orderBy(order)
        once = good.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        seen = self.committed(before=batch)
        fresh = once if seen is None else once.join(seen.select(*self.keys).distinct(), self.keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        loaded = self.spark.read.parquet(f"{self.path}/batch={batch}").count()
        usable = good.count()
        return {"received": received, "rejected": received - usable, "duplicates": usable - loaded, "loaded": loaded}
