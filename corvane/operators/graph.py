"""Traversal of labelled graphs held as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbour, seq, confidence): both directions of (start, end, seq, confidence)."""
    a = edges.select(F.col("start").alias("node"), F.col("end").alias("neighbour"), "seq", "confidence")
    return a.unionByName(edges.select(F.col("end").alias("node"), F.col("start").alias("neighbour"), "seq", "confidence"))


def traverse(edges: DataFrame, starts: DataFrame, hops: int = 2, decay: float = 0.8, least: float = 0.0, per_node: int | None = None) -> DataFrame:
    """(origin, node, hop, confidence): breadth-first from each start; a node is reached by its first path.

    Among paths of equal length the edge written first (smallest seq) wins. With ``per_node`` only so many edges,
    the first written, leave a node per hop. Confidence is the product of the edges' times ``decay`` per hop; below ``least`` a path ends.
    """
    adjacent = neighbours(edges)
    ranked = adjacent
    if per_node is not None:
        ranked = adjacent.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("seq", "neighbour"))).where(F.col("_r") <= per_node).drop("_r")
    seen = starts.select(F.col("node").alias("origin"), "node", F.lit(0).alias("hop"), F.lit(1.0).alias("confidence")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(ranked.withColumnRenamed("confidence", "_c"), "node").select("origin", F.col("neighbour").alias("node"), (F.col("confidence") * F.col("_c") * decay).alias("confidence"), F.struct("seq", "node").alias("_o"))
        first = step.where(F.col("confidence") >= least).groupBy("origin", "node").agg(F.min_by("confidence", "_o").alias("confidence"))
        frontier = first.join(seen, ["origin", "node"], "left_anti").select("origin", "node", F.lit(hop).alias("hop"), "confidence")
        seen = seen.unionByName(frontier)
    return seen.withColumn("confidence", F.round("confidence", 6))


def best_paths(reached: DataFrame, limit: int) -> DataFrame:
    """(node, origin, hop, confidence, rank): of each node reached the path of highest confidence, the ``limit`` best of them.

    Ties go to fewer hops, then to the smaller origin and node. Starts themselves are no answers.
    """
    best = reached.where("hop > 0").groupBy("node").agg(F.min(F.struct((-F.col("confidence")).alias("minus"), "hop", "origin", "confidence")).alias("p"))
    top = best.select("node", "p.origin", "p.hop", "p.confidence").orderBy(F.desc("confidence"), "hop", "node").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("confidence"), "hop", "node")))  # over limit rows


def node_matches(nodes: DataFrame, query: str, shortest: int = 3) -> DataFrame:
    """(node, label, overlap): nodes whose text shares words of at least ``shortest`` letters with ``query``, most first."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"([a-z0-9]{{{shortest},}})"), F.lit(1)))
    overlap = F.size(F.array_intersect(words(F.col("text")), words(F.lit(query))))
    return nodes.select("node", "label", overlap.cast("long").alias("overlap")).where("overlap > 0").orderBy(F.desc("overlap"), "label", "node")


def entry_points(matches: DataFrame, per_label: int = 2, limit: int = 6) -> DataFrame:
    """The best ``per_label`` matches of each label by (overlap desc, node), at most ``limit`` in all."""
    w = Window.partitionBy("label").orderBy(F.desc("overlap"), "node")
    return matches.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_label).drop("_n").orderBy(F.desc("overlap"), "label", "node").limit(limit)


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, properties): properties merged per node; of one name the new value wins, then the later ``seq``. Null nodes are left out."""
    rows = old.select("node", "properties", F.lit(0).alias("_age"), F.lit(0).cast("long").alias("seq")).unionByName(new.select("node", "properties", F.lit(1).alias("_age"), F.col("seq").cast("long").alias("seq")))
    one = rows.where("node is not null").select("node", "_age", "seq", F.explode("properties").alias("name", "value"))
    last = one.groupBy("node", "name").agg(F.max_by("value", F.struct("_age", "seq", "value")).alias("value"))
    return last.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("properties"))
