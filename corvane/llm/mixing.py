"""Mixing sources to target weights.

Token counts per cell of source, language and topic are raked by iterative proportional fitting until the
cell weights meet the marginals of all three; a cell's weight is the expected number of copies of each of
its documents. Documents are then drawn by a hash of their id with thresholds that are calibrated on the
token counts, so that the shares reached differ from the targets by a fraction of a document's size.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Where the vocabulary lies by default, and the split pattern that belongs to it.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BINS = 1024


def with_tokens(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, keep: tuple[str, ...] = ("doc_id", "source", "lang", "topic")) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of tokens of the whole ``text``; 0 for null and empty texts.

    ``vocabulary`` is a file of base64 ranks on the driver, which is sent to every executor.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    file = os.path.basename(vocabulary)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema) + ", tokens long"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(SparkFiles.get(file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("mixing", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pdf[list(keep)].assign(tokens=[len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["text"]])

    return documents.select(*keep, "text").mapInPandas(count, schema)


def rake(cells: pd.DataFrame, marginals: dict[str, dict[str, float]], total: float, caps: dict[str, float], rounds: int = 200) -> np.ndarray:
    """Copies per cell so that the cells' tokens times copies meet the marginal shares of ``total``.

    ``cells`` has one column per marginal and ``tokens``. Copies stay within the cap of the cell's source. Marginals
    are fitted in turn, the source last, so that where they contradict the source's share holds.
    """
    tokens = cells["tokens"].to_numpy(float)
    cap = cells["source"].map(caps).to_numpy(float)
    copies = np.minimum(np.ones(len(cells)), cap)
    order = [k for k in marginals if k != "source"] + ["source"]
    groups = {k: [(np.flatnonzero((cells[k] == v).to_numpy()), share * total) for v, share in marginals[k].items()] for k in order}
    for _ in range(rounds):
        before = copies.copy()
        for k in order:
            for rows, target in groups[k]:
                # what capped cells can't give, the others of the group take over
                for _ in range(20):
                    now = (copies[rows] * tokens[rows]).sum()
                    free = rows[copies[rows] < cap[rows] - 1e-12] if now < target else rows
                    have = (copies[free] * tokens[free]).sum()
                    if not len(free) or have <= 0 or abs(now - target) <= 1e-9 * total:
                        break
                    copies[free] = np.minimum(copies[free] * max(0.0, (target - now + have) / have), cap[free])
        if np.abs(copies - before).max() < 1e-9:
            break
    return copies


def _largest(cells: pd.DataFrame, marginals: dict[str, dict[str, float]], caps: dict[str, float]) -> float:
    """The largest total at which raking meets the marginals with all caps kept.

    Where they contradict each other at any size, the largest one at which no cap binds.
    """
    tokens, cap = cells["tokens"].to_numpy(float), cells["source"].map(caps).to_numpy(float)
    groups = [((cells[k] == v).to_numpy(), share) for k, shares in marginals.items() for v, share in shares.items()]

    def met(total: float) -> bool:
        mass = rake(cells, marginals, total, caps) * tokens
        return all(abs(mass[rows].sum() - share * total) <= 1e-3 * share * total for rows, share in groups)

    free = rake(cells, marginals, 1.0, dict.fromkeys(caps, np.inf))
    low = float((cap[free > 0] / free[free > 0]).min(initial=np.inf))
    high = min((cap[rows] * tokens[rows]).sum() / share for rows, share in groups)
    if not np.isfinite(low) or low >= high or not met(low):
        return min(low, high)
    for _ in range(20):
        middle = (low + high) / 2
        low, high = (middle, high) if met(middle) else (low, middle)
    return low


def _ends(fine: pd.DataFrame) -> pd.DataFrame:
    """(source, lang, topic, end): up to which fine bin each cell of one source is drawn.

    ``fine`` has the sums of the fine bins of the bin that each cell is cut in; what a cell's last document misses or
    exceeds goes to the source's next cell.
    """
    rows, carry = [], 0.0
    for (source, lang, topic), cell in fine.groupby(["source", "lang", "topic"], sort=True):
        if cell["capped"].iloc[0]:  # at its cap a cell can't take over any
            continue
        wanted = cell["rest"].iloc[0] + carry
        cell = cell[cell["f"] >= 0].sort_values("f")
        have = np.concatenate(([0.0], np.cumsum(cell["tokens"].to_numpy(float))))
        worse = np.flatnonzero(np.abs(have[1:] - wanted) > np.abs(have[:-1] - wanted))
        k = int(worse[0]) if len(worse) else len(cell)
        carry = wanted - have[k]
        rows.append((source, lang, topic, int(cell["f"].iloc[k - 1]) + 1 if k else 0))
    return pd.DataFrame(rows, columns=["source", "lang", "topic", "end"])


def mix(documents: DataFrame, targets: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY, total_tokens: float | None = None, seed: int = 17, languages: dict[str, float] | None = None, topics: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: (doc_id, source, lang, topic, tokens, copies), one row per drawn document with its number of copies.
    report: (source, target_share, reached_share, available_tokens, mixed_tokens, largest_copies, max_repeats), one row per target.

    ``documents`` needs doc_id, source, lang, document_type and text; ``targets`` source, target_share and max_repeats.
    Without ``total_tokens`` the mixture is as large as the targets allow with all caps kept. With it, sources at their
    cap fall short and the report says so. Documents without a target, of a null source or without tokens aren't
    drawn; null languages and topics form a group of their own. A target without documents reaches 0. Targets whose
    shares don't add up to 1 are scaled. Repeated rows of a document are drawn alike.

    ``languages`` and ``topics`` are target shares by value (``unknown`` for null), for which the cells are raked too;
    documents of other languages or topics aren't drawn, and where such targets contradict the sources' these hold.
    Without them languages and topics keep the shares that the sources bring along: then the source alone has an
    effect, unless ``total_tokens`` makes caps bind.
    """
    spark = documents.sparkSession
    goal = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).toPandas()  # one row per source
    goal["share"] = goal["target_share"] / max(goal["target_share"].sum(), 1e-300)
    known = documents.join(targets.where("source is not null and target_share > 0").select("source").distinct(), "source", "left_semi").where("doc_id is not null")
    sized = materialize(with_tokens(known.withColumns({"topic": F.coalesce("document_type", F.lit("unknown")), "lang": F.coalesce("lang", F.lit("unknown"))}), vocabulary), "sized")
    asked = {k: {v: float(x) for v, x in t.items() if x > 0} for k, t in (("lang", languages), ("topic", topics)) if t is not None}
    for k, t in asked.items():
        sized = sized.where(F.col(k).isin(*t))
    sized = sized.where("tokens > 0").withColumn("_h", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(_BINS * _BINS)))
    binned = materialize(sized.groupBy("source", "lang", "topic", F.floor(F.col("_h") / _BINS).alias("bin")).agg(F.sum("tokens").alias("tokens")), "bins")
    cells = binned.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).toPandas()  # one sum per combination
    cells = cells.sort_values(["source", "lang", "topic"]).reset_index(drop=True)
    available = cells.groupby("source")["tokens"].sum().to_dict()
    caps = dict(zip(goal["source"], goal["max_repeats"].astype(float)))
    present = goal[goal["source"].isin(available)]
    # without targets, languages and topics keep the shares that the sources bring with them at their target shares
    cells["brought"] = cells["tokens"] * cells["source"].map({s: share / available[s] for s, share in zip(present["source"], present["share"])})
    marginals = {k: (cells.groupby(k)["brought"].sum() / max(cells["brought"].sum(), 1e-300)).to_dict() for k in ("lang", "topic")}
    for k, t in asked.items():
        there = {v: share for v, share in t.items() if v in marginals[k]}
        marginals[k] = {v: share / sum(there.values()) * present["share"].sum() for v, share in there.items()}
    if asked:  # what has no target of its own is free
        marginals |= {k: {} for k in ("lang", "topic") if k not in asked}
    marginals["source"] = dict(zip(present["source"], present["share"]))
    if total_tokens is not None:
        total = float(total_tokens)
    elif asked and len(cells):
        total = _largest(cells, marginals, caps)
    else:
        total = min((available[s] * caps[s] / share for s, share in zip(present["source"], present["share"])), default=0.0)
    cells["copies"] = rake(cells, marginals, total, caps) if len(cells) else []
    cells["base"] = np.floor(cells["copies"] + 1e-9).astype("int64") if len(cells) else []
    cells["extra"] = (cells["copies"] - cells["base"]).clip(lower=0) * cells["tokens"] if len(cells) else []
    # thresholds: whole bins from the smallest hash on, then the fine bins of the one that is cut
    cell = ["source", "lang", "topic"]
    rules = spark.createDataFrame([(r.source, r.lang, r.topic, int(r.base), float(r.extra), bool(r.base >= caps[r.source])) for r in cells.itertuples()], "source string, lang string, topic string, base long, extra double, capped boolean")
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(*cell).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = binned.withColumn("before", before).join(rules, cell)
    first = reached.where(F.col("before") + F.col("tokens") > F.col("extra")).groupBy(*cell).agg(F.min(F.struct("bin", (F.col("extra") - F.col("before")).alias("rest"))).alias("at"))
    cut = rules.join(first.select(*cell, F.col("at.bin").alias("cut"), F.col("at.rest").alias("rest")), cell, "left")
    cut = materialize(cut.select(*cell, "base", "capped", F.coalesce("cut", F.lit(_BINS)).alias("cut"), F.coalesce("rest", F.lit(0.0)).alias("rest")), "cuts")
    inside = sized.join(cut.select(*cell, "cut"), cell).where(F.floor(F.col("_h") / _BINS) == F.col("cut"))
    inside = inside.groupBy(*cell, F.pmod("_h", F.lit(_BINS)).alias("f")).agg(F.sum("tokens").alias("tokens"))
    fine = cut.select(*cell, "capped", "rest").join(inside, cell, "left").select(*cell, "capped", "rest", F.coalesce("f", F.lit(-1)).cast("long").alias("f"), F.coalesce("tokens", F.lit(0)).cast("double").alias("tokens"))
    ends = fine.groupBy("source").applyInPandas(_ends, "source string, lang string, topic string, end long")  # at most as many sums as cells times bins
    final = cut.join(ends, cell, "left").select(*cell, "base", (F.col("cut") * _BINS + F.coalesce("end", F.lit(0))).alias("below"))
    drawn = sized.join(final, cell).withColumn("copies", F.col("base") + (F.col("_h") < F.col("below")).cast("long"))
    mixture = drawn.where("copies > 0").select("doc_id", "source", "lang", "topic", "tokens", "copies")
    sums_of = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("largest_copies"))
    whole = F.sum("mixed_tokens").over(Window.partitionBy())  # the report has one row per target
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    report = targets.where("source is not null and target_share > 0").select("source", "target_share", F.col("max_repeats").cast("long").alias("max_repeats")).join(have, "source", "left").join(sums_of, "source", "left").withColumn("_all", whole)
    report = report.select(
        "source", "target_share", F.coalesce(F.col("mixed_tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("largest_copies", F.lit(0)).alias("largest_copies"), "max_repeats",
    )
    return mixture, report
