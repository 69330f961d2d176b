"""Evidence of several sources: duplicates, numbers that agree or conflict, checks of claims, buckets and claims of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBER = r"(\d+(?:\.\d+)?)"


def deduplicate(rows: DataFrame, content: str, order: list[Column], keep: int | None = None) -> DataFrame:
    """The first row per content (without case and differences of white space) by ``order``, at most ``keep`` per call if given."""
    digest = F.sha2(F.trim(F.regexp_replace(F.lower(content), r"\s+", " ")), 256)
    once = rows.withColumn("_d", digest).withColumn("_n", F.row_number().over(Window.partitionBy("_d").orderBy(*order))).where("_n = 1").drop("_n", "_d")
    return once if keep is None else once.orderBy(*order).limit(keep)


def numbers(text: Column) -> Column:
    """The distinct numbers of a text as texts."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(1)))


def corroborated(rows: DataFrame, group: str, kind: str, text: str) -> DataFrame:
    """(group, number, kinds): numbers that more than one kind of source of a group gives."""
    n = rows.where(F.col(text).isNotNull()).select(group, kind, F.explode(numbers(F.col(text))).alias("number")).distinct()
    return n.groupBy(group, "number").agg(F.count("*").alias("kinds")).where("kinds > 1")


def coverage(claim: Column, source: Column) -> Column:
    """Share of a claim's distinct words that its source holds; null for a claim without words."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]{3,})"), F.lit(1)))
    own = words(claim)
    return F.size(F.array_intersect(own, words(source))) / F.nullif(F.size(own), F.lit(0))


def bucket(identity: Column, name: str, buckets: int = 100) -> Column:
    """A stable bucket of an identity for a named rollout."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(name + ":"), identity.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def claim_heads(outbox: DataFrame, now: Column, limit: int) -> DataFrame:
    """The oldest due heads of an outbox (partition, sequence, due_at): a head that isn't due blocks its partition."""
    heads = outbox.withColumn("_n", F.row_number().over(Window.partitionBy("partition").orderBy("sequence"))).where("_n = 1").drop("_n")
    return heads.where(F.col("due_at") <= now).orderBy("due_at", "partition", "sequence").limit(limit)
