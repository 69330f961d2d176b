"""Session helpers: table access and the shared folder for cut lineages."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset and Spark runs on one machine, as in tests,
    a temporary folder is made and set as the checkpoint folder. A cluster without the setting is refused.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="corvane-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application. Results that are still to be read must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that its lineage ends at files.

    Unlike a cache, the files outlive an executor. An empty result keeps its schema.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting that deletes the shuffle files of a query once it has run.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize_parts(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """The rows of all ``parts``, which have one schema, written one after the other to one table in the shared folder.

    The shuffle files of a part are deleted before the next one is written, so that the disk holds those of one part.
    """
    path, schema = None, None
    for df in parts:
        path, schema, spark = path or fresh_path(df.sparkSession, label), df.schema, df.sparkSession
        before = spark.conf.get(_CLEAN_UP, "false")
        spark.conf.set(_CLEAN_UP, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def local_path(path: str) -> str:
    """``path`` without a ``file:`` scheme, for libraries that open files themselves."""
    return os.path.abspath(path.split(":", 1)[1].replace("//", "/")) if path.startswith("file:") else path
