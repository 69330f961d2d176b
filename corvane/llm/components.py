"""Pairwise links consolidated into groups.

Union-find runs inside each partition of edges and keeps only a spanning forest (each record points at the
smallest one of its local tree). Forests are then merged hierarchically: at each level, groups of partitions
come together, are merged by union-find and again keep only their forest, as long as what meets stays within
the bound of a task. Where a level would exceed it, pointers are shortened over hash partitions instead, until
every record points straight at a root. Records never travel to the driver; hub records have one edge per
linked record, which is spread by the *other* end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For codes 0..n-1 the smallest code of the component that the edges u-v form."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:  # path halving until all point at roots
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def spanning_forest(pairs: pd.DataFrame) -> pd.DataFrame:
    """(child, root) of the records of ``pairs`` that aren't the smallest of their local component."""
    names, codes = np.unique(np.concatenate((pairs["child"].to_numpy(dtype=object), pairs["root"].to_numpy(dtype=object))).astype(str), return_inverse=True)
    half = len(pairs)
    parent = _roots(codes[:half], codes[half:], len(names))
    below = np.flatnonzero(parent != np.arange(len(names)))
    return pd.DataFrame({"child": names[below].astype(object), "root": names[parent[below]].astype(object)})


_EDGE = "child string, root string"


def _forest_of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest, waiting, size = None, [], 0
    for pdf in batches:
        waiting.append(pdf)
        size += len(pdf)
        if size > 200_000:  # memory stays with the forest, not with the edges
            forest = spanning_forest(pd.concat([*([forest] if forest is not None else []), *waiting]))
            waiting, size = [], 0
    if waiting:
        forest = spanning_forest(pd.concat([*([forest] if forest is not None else []), *waiting]))
    if forest is not None:
        for at in range(0, len(forest), 50_000):
            yield forest.iloc[at : at + 50_000]


def _merged(forest: DataFrame, parts: int, max_task_edges: int, fan: int) -> tuple[DataFrame, int]:
    """(forest, partitions) after the levels of the hierarchy that keep within the bound; ``forest`` has the partition ``part``."""
    while parts > 1:
        above = -(-parts // fan)
        group = F.floor(F.col("part") / fan).cast("int")
        if (forest.groupBy(group).count().agg(F.max("count")).first()[0] or 0) > max_task_edges:
            break
        met = forest.withColumn("part", group).repartitionById(above, F.col("part"))
        forest, parts = _numbered(met.select("child", "root")), above
    return forest, parts


def _numbered(edges: DataFrame) -> DataFrame:
    """The forests of the partitions of ``edges`` with the number of their partition."""
    return materialize(edges.mapInPandas(_forest_of_partition, _EDGE).withColumn("part", F.spark_partition_id()), "forest")


def connected_components(edges: DataFrame, left: str, right: str, max_task_edges: int = 2_000_000, fan: int = 4) -> DataFrame:
    """(record_id, group_id): each record of an edge with the smallest record of its component.

    Edges with a null end and self pairs link nothing; repeated and reversed edges count once; an empty table gives
    an empty result. ``fan`` forests meet at each level of the hierarchy, at most ``max_task_edges`` of their
    edges in one task; what is larger is resolved over hash partitions, without losing a link.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(left, right).cast("string").alias("child"), F.least(left, right).cast("string").alias("root"), F.col(left).alias("_l"), F.col(right).alias("_r"))
    pairs = pairs.where(F.col("_l").isNotNull() & F.col("_r").isNotNull() & (F.col("child") != F.col("root"))).select("child", "root")
    forest = _numbered(pairs)
    parts = (forest.agg(F.max("part")).first()[0] or 0) + 1
    forest, parts = _merged(forest, parts, max_task_edges, fan)
    if parts > 1:
        forest = _shortened(forest.drop("part"), max_task_edges)
    return forest.select(F.col("child").alias("record_id"), F.col("root").alias("group_id")).union(forest.select("root", "root").distinct())


def _shortened(forest: DataFrame, max_task_edges: int) -> DataFrame:
    """The forest of all partitions, each record pointing at the root: pointers to pointing records are shortened in rounds.

    A round at least halves the longest way to a root, so it ends.
    """
    n = max(2, int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-forest.count() // max_task_edges))
    while True:
        # every pointer of a record meets in one partition
        local = materialize(forest.repartition(n, "child").mapInPandas(_forest_of_partition, _EDGE), "forest")
        # pointers to pointing records are shortened; the hub of many pointers is split over salts
        up = local.groupBy("child").agg(F.min("root").alias("up"))
        salts = F.pmod(F.xxhash64("child"), F.lit(16))
        target = up.select(F.col("child").alias("root"), "up").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
        jumped = local.withColumn("_s", salts).join(target, ["root", "_s"], "left")
        step = materialize(jumped.select("child", "root", "up"), "forest")
        shorter = step.select("child", F.coalesce("up", "root").alias("root"))
        links = step.where(F.col("up").isNotNull()).select(F.col("root").alias("child"), F.col("up").alias("root")).distinct()
        split = local.groupBy("child").count().where("count > 1").limit(1).count()
        if not split and links.limit(1).count() == 0:
            return local
        forest = materialize(shorter.union(links).mapInPandas(_forest_of_partition, _EDGE).distinct(), "forest")


def match_links(scores: DataFrame, minimum_total: float = 16.0) -> DataFrame:
    """(left_record_id, right_record_id) of the rows of a score table that link two records.

    A row links if its zone, without blanks and case, is ``match``, or if it has no zone (null or blank) and a
    total of at least ``minimum_total``; a null total without zone doesn't.
    """
    zone = F.lower(F.trim("zone"))
    none = F.col("zone").isNull() | (zone == "")
    return scores.where((zone == "match") | (none & (F.col("total") >= minimum_total))).select("left_record_id", "right_record_id")
