"""Ranked retrieval: keyword and vector scores, rank fusion, reranking and their evaluation."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..session import materialize


def bm25(documents: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents per query, all of (query_id, query_text) against all of (doc_id, text).

    Statistics come from the given documents, so filter them first. Repeated query terms count twice. Only the postings of
    query terms are joined; per-document scores are partial sums before the ranking. Ties go to the smaller doc_id.
    """
    seen = Observation()
    tokens = documents.where("text is not null").select("doc_id", terms(F.col("text")).alias("t")).withColumn("n", F.size("t")).observe(seen, F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    wanted = queries.select("query_id", F.explode(terms(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    vocabulary = wanted.select("term").distinct()
    # texts are split once, and the postings of query terms alone are shuffled
    postings = tokens.select("doc_id", "n", F.explode("t").alias("term")).join(vocabulary, "term", "left_semi")
    tf = materialize(postings.groupBy("doc_id", "n", "term").agg(F.count("*").alias("tf")), "postings")
    docs, mean = seen.get["docs"], (seen.get["tokens"] or 0) / max(1, seen.get["docs"]) or 1.0  # of the same pass
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.log1p((F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    hit = tf.join(idf, "term").select("doc_id", "term", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / mean))).alias("s"))
    scored = hit.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("s") * F.col("times")), 6).alias("score")).where("score > 0")
    return top_k(scored, k)


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query by (score desc, doc_id), with their rank. Windows with a rank limit keep k rows per input partition before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot / size)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 256, minimum: float = 0.0) -> DataFrame:
    """(query_id, doc_id, score, rank): exact top k by (cosine + 1) / 2 of every query vector against all vectors.

    ``queries`` and ``vectors`` have (query_id | doc_id, embedding). Queries are grouped into blocks whose matrix goes
    along with the scan of the vectors; each Arrow batch returns only its own k best per query, which are then merged.
    """
    grouped = queries.where("embedding is not null").groupBy(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // block)))).alias("g")).agg(F.collect_list(F.struct("query_id", "embedding")).alias("q"))
    out = None
    for row in grouped.toLocalIterator():  # one block of queries at a time
        ids = [x.query_id for x in row.q]
        matrix = np.array([x.embedding for x in row.q], np.float64)
        norms = np.linalg.norm(matrix, axis=1)
        unit = matrix / np.where(norms == 0, 1, norms)[:, None]

        def best(batches: Iterator[pd.DataFrame], ids=ids, unit=unit) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                v = np.vstack(pdf["embedding"].to_numpy()).astype(np.float64)
                n = np.linalg.norm(v, axis=1)
                score = np.clip((unit @ (v / np.where(n == 0, 1, n)[:, None]).T + 1) / 2, 0, 1)
                docs = pdf["doc_id"].to_numpy()
                keep = min(k, len(docs))
                rows = []
                for i, q in enumerate(ids):
                    order = np.lexsort((docs, -np.round(score[i], 6)))[:keep]
                    rows += [(q, docs[j], round(float(score[i, j]), 6)) for j in order if score[i, j] >= minimum]
                yield pd.DataFrame(rows, columns=["query_id", "doc_id", "score"])

        part = vectors.where("embedding is not null").select("doc_id", "embedding").mapInPandas(best, "query_id long, doc_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return top_k(out, k)


def fuse(rankings: dict[str, DataFrame], k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, doc_id, fused, strategies): reciprocal rank fusion, the sum of weight / (k + rank) over the strategies that rank a document."""
    parts = None
    for name, r in rankings.items():
        p = r.where("rank is not null").select("query_id", "doc_id", F.lit(name).alias("s"), (F.lit((weights or {}).get(name, 1.0)) / (k + F.col("rank"))).alias("w"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 9).alias("fused"), F.array_sort(F.collect_set("s")).alias("strategies"))


def freshness(date: Column, today: Column, half_life: float = 730.0) -> Column:
    """Halves every ``half_life`` days; 0.5 for an undated text, 1 for a future one."""
    return F.when(date.isNull(), 0.5).otherwise(F.pow(F.lit(0.5), F.greatest(F.datediff(today, date), F.lit(0)) / half_life))


def rank_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision, recall, reciprocal_rank, average_precision, ndcg) at k from (query_id, doc_id, rank) and (query_id, doc_id, gain).

    precision divides by k even if fewer are ranked; ndcg uses linear gain. Queries without ranked documents get zeros.
    """
    gains = relevant.groupBy("query_id", "doc_id").agg(F.max("gain").alias("gain"))
    totals = gains.where("gain > 0").groupBy("query_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.col("gain").cast("double")), asc=False).alias("ideal"))
    hits = ranked.where(F.col("rank") <= k).join(gains.where("gain > 0"), ["query_id", "doc_id"])
    w = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("seen", F.row_number().over(w))
    per = hits.groupBy("query_id").agg(F.count("*").alias("h"), F.min("rank").alias("first"), F.sum(F.col("seen") / F.col("rank")).alias("ap"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.transform(F.slice("ideal", 1, k), lambda g, i: g / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    r = totals.join(per, "query_id", "left")
    zero = F.lit(0.0)
    return r.select(
        "query_id", F.round(F.coalesce(F.col("h") / k, zero), 6).alias("precision"), F.round(F.coalesce(F.col("h") / F.col("n"), zero), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), zero), 6).alias("reciprocal_rank"),
        F.round(F.coalesce(F.col("ap") / F.col("n"), zero), 6).alias("average_precision"), F.round(F.coalesce(F.col("dcg") / ideal, zero), 6).alias("ndcg"),
    )


_EMBEDDED_WORD = re.compile(r"[^\W_]+")


def embed_batch(texts: list[str | None], dimensions: int = 384) -> np.ndarray:
    """One row per text: words and neighbouring word pairs as hashed features, damped by a square root; unit length.

    Every feature adds its damped count, pairs half of it, to two places, with signs of their own. A null text and one
    without words give the zero vector. The vectors are only comparable with others made here.
    """
    words = [_EMBEDDED_WORD.findall(t.lower()) if isinstance(t, str) else [] for t in texts]
    features = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in words]
    rows = np.repeat(np.arange(len(texts)), [len(f) for f in features])
    out = np.zeros((len(texts), dimensions))
    if not len(rows):
        return out
    codes, names = pd.factorize(np.array([x for f in features for x in f], object))
    hashed = pd.util.hash_array(np.asarray(names, object), categorize=False)
    weight = np.where([" " in n for n in names], 0.5, 1.0)
    pairs, counts = np.unique(rows.astype(np.int64) * len(names) + codes, return_counts=True)
    row, code = pairs // len(names), pairs % len(names)
    value = np.sqrt(counts) * weight[code]
    for shift in (0, 32):
        part = hashed[code] >> np.uint64(shift)
        at = (part % np.uint64(dimensions)).astype(np.int64)
        sign = np.where((part >> np.uint64(31)) & np.uint64(1), 1.0, -1.0)
        np.add.at(out, (row, at), sign * value)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size == 0, 1, size)


def embed(documents: DataFrame, dimensions: int = 384) -> DataFrame:
    """(doc_id, embedding): hashed lexical embeddings; each different text is embedded once and joined back."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"digest": pdf["digest"], "embedding": list(embed_batch(pdf["text"].tolist(), dimensions).astype("float32"))})

    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    once = d.groupBy("digest").agg(F.first("text").alias("text")).mapInPandas(vectors, "digest string, embedding array<float>")
    return d.select("doc_id", "digest").join(once, "digest").select("doc_id", "embedding")


def pack_context(candidates: DataFrame, budget: int = 5000, blocks: int = 20) -> DataFrame:
    """(query_id, id, rank, tokens): per query the candidates that fit a token budget, in rank order.

    ``candidates`` has query_id, id, text, rank. Equal contents are packed once; a block over the rest of the budget is
    skipped and smaller ones after it still fit. All candidates are read, however many a query has: they are sorted
    without their texts and pass by in batches, of which only the rest of the budget is kept.
    """
    from ..functions.text import content_digest, token_estimate

    c = candidates.where("text is not null").select(F.col("query_id").cast("long"), F.col("id").cast("string"), F.col("rank").cast("long").alias("rank"), token_estimate(F.col("text")).alias("tokens"), content_digest(F.col("text")).alias("digest"))
    once = c.withColumn("_d", F.row_number().over(Window.partitionBy("query_id", "digest").orderBy("rank", "id"))).where("_d = 1")
    walk = once.select("query_id", "id", "rank", "tokens").repartition("query_id").sortWithinPartitions("query_id", F.asc_nulls_last("rank"), F.asc_nulls_last("id"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, rest, placed = (), budget, 0  # no query yet; a null one is None
        for batch in batches:
            ids, tokens = batch.column("query_id"), batch.column("tokens").to_numpy(zero_copy_only=False)
            known, value = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            changes = np.flatnonzero((known[1:] != known[:-1]) | (value[1:] != value[:-1])) + 1
            kept = []
            for start, end in zip([0, *changes], [*changes, len(tokens)]):
                if start < end and (mine := ids[int(start)].as_py()) != query:
                    query, rest, placed = mine, budget, 0
                while placed < blocks and (fit := tokens[start:end] <= rest).any():
                    start += int(fit.argmax())
                    kept.append(start)
                    rest -= tokens[start]
                    start, placed = start + 1, placed + 1
            yield batch.take(pa.array(kept, pa.int64()))

    return walk.mapInArrow(fill, "query_id long, id string, rank long, tokens long")


def filtered(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns hold the wanted value, or one of a list of them; a null never does.

    Applied before statistics and scores, as it defines what is searched. An unknown column is refused.
    """
    if missing := set(wanted) - set(rows.columns):
        raise ValueError(f"unknown columns {sorted(missing)}")
    for name, value in wanted.items():
        rows = rows.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return rows


def tenant_check(candidates: DataFrame, tenants: DataFrame, query: str = "query_id", tenant: str = "tenant_id") -> tuple[DataFrame, DataFrame]:
    """(candidates of their query's own tenant, (query, rejected) counts of the others); a null tenant is another one."""
    own = tenants.select(query, F.col(tenant).alias("_own")).distinct()
    marked = candidates.join(own, query).withColumn("_ok", F.coalesce(F.col(tenant) == F.col("_own"), F.lit(False)))
    return marked.where("_ok").drop("_own", "_ok"), marked.groupBy(query).agg(F.count_if(~F.col("_ok")).alias("rejected"))


def relative_score(candidates: DataFrame, now: Column, fusion_weight: float = 3.0, fresh_weight: float = 0.5) -> DataFrame:
    """(query_id, id, score): fusion relative to the query's best, and freshness, weighted."""
    top = F.max("fused_score").over(Window.partitionBy("query_id"))
    fusion = F.col("fused_score") / F.when(top > 0, top).otherwise(1.0)
    return candidates.select("query_id", "id", F.round((fusion_weight * fusion + fresh_weight * freshness(F.col("effective_date"), now)) / (fusion_weight + fresh_weight), 6).alias("score"))


def above_floor(candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """Candidates that some strategy scores at least ``least``; without scores they are left out."""
    return candidates.where(F.exists(F.map_values("scores"), lambda s: s >= least))


def evaluation_summary(cases: DataFrame, metrics: list[str], latency: str) -> DataFrame:
    """One row: the mean of each metric over the cases that have it, and the latencies p50 and p95 by nearest rank, rounded up."""
    means = [F.round(F.avg(m), 6).alias(m) for m in metrics]
    return cases.agg(F.count("*").alias("cases"), *means, *[F.expr(f"percentile_disc({p}) within group (order by `{latency}`)").alias(f"p{round(p * 100)}") for p in (0.5, 0.95)])
