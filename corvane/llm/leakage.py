"""Evaluation texts leaking into training text.

Multi-pattern search after Wu and Manber over words instead of characters: the patterns are all runs of
``run`` words of the test items. A shift table over blocks of two words tells how far a window may move
without missing a pattern; where the shift is zero, the bucket of the suffix hash selects the patterns
that are compared directly. All documents of a chunk move in lockstep as numpy arrays. Confirmed runs are
chained to passages, which decide whether at least half of an item stands in the document.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_TABLE_BITS = 20


def words_of(text: str | None) -> list[str]:
    """Words without case, punctuation and white space; none for a null text."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold()) if isinstance(text, str) else []


def _block_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


class WordSearch:
    """Shift table and suffix buckets of all runs of words of some items."""

    def __init__(self, items: list[tuple[int, str]], run: int = 4):
        self.run, self.vocabulary = run, {}
        self.short: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
        self.lengths: dict[int, int] = {}
        where: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            words = words_of(text)
            self.lengths[item] = len(words)
            if 0 < len(words) < run:
                self.short[len(words)].append((item, words))
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for at in range(len(ids) - run + 1):
                where[tuple(ids[at : at + run])].append((item, at))
        patterns = np.array(list(where), np.int64).reshape(-1, run)
        self.places = list(where.values())
        self.shift = np.full(1 << _TABLE_BITS, run - 1, np.int8)
        for end in range(1, run):  # a block that ends at word `end` of a pattern
            np.minimum.at(self.shift, _block_hash(patterns[:, end - 1], patterns[:, end]), run - 1 - end)
        suffix = _block_hash(patterns[:, -2], patterns[:, -1])
        order = np.argsort(suffix, kind="stable")
        self.patterns, self.suffix, self.order = patterns[order], suffix[order], order

    def whole(self, texts: list[list[str]]) -> Iterator[tuple[int, int]]:
        """(text, item) of the items shorter than a run that a text holds whole."""
        for n, items in self.short.items():
            wanted: dict[tuple[str, ...], list[int]] = defaultdict(list)
            for item, words in items:
                wanted[tuple(words)].append(item)
            for k, words in enumerate(texts):
                for found in wanted.keys() & set(zip(*(words[j:] for j in range(n)))):
                    yield from ((k, item) for item in wanted[found])

    def find(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word position, pattern) of every occurrence of a pattern."""
        get, run = self.vocabulary.get, self.run
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.fromiter((get(w, 0) for t in texts for w in t), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        alive = np.flatnonzero(sizes >= run)
        at, stop = begins[alive] + run - 1, ends[alive]
        texts_hit, places_hit, patterns_hit = [], [], []
        while len(alive):
            block = _block_hash(data[at - 1], data[at])
            step = self.shift[block].astype(np.int64)
            zero = np.flatnonzero(step == 0)
            if len(zero) and len(self.suffix):
                lo, hi = np.searchsorted(self.suffix, block[zero], "left"), np.searchsorted(self.suffix, block[zero], "right")
                many = hi - lo
                window = np.repeat(at[zero] - run + 1, many)
                candidate = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                same = np.ones(len(window), bool)
                for k in range(run):
                    same &= data[window + k] == self.patterns[candidate, k]
                texts_hit.append(np.repeat(alive[zero], many)[same])
                places_hit.append(window[same])
                patterns_hit.append(self.order[candidate[same]])
            at = at + np.maximum(step, 1)
            go = at < stop
            alive, at, stop = alive[go], at[go], stop[go]
        if not texts_hit:
            none = np.zeros(0, np.int64)
            return none, none, none
        t = np.concatenate(texts_hit)
        return t, np.concatenate(places_hit) - begins[t], np.concatenate(patterns_hit)


def passages(seeds: list[tuple[int, int]], run: int, gap: int = 4) -> list[tuple[int, int, int, int]]:
    """Running passages (item begin, item end, document begin, document end; ends exclusive) from (item, document) seed positions.

    Seeds on one diagonal join; up to ``gap`` dropped, added or replaced words may lie between two joined pieces.
    """
    pieces: list[list[int]] = []
    last: dict[int, list[int]] = {}
    for i, d in sorted(seeds):
        piece = last.get(d - i)
        if piece and i <= piece[1]:
            piece[1], piece[3] = i + run, d + run
        else:
            last[d - i] = piece = [i, i + run, d, d + run]
            pieces.append(piece)
    pieces.sort(key=lambda p: (p[2], p[0]))
    best: list[tuple[int, int, int, int]] = []
    near: list[tuple[int, int, int, int]] = []  # those that a piece beginning here or later may continue
    for i0, i1, d0, d1 in pieces:
        own = (i0, i1, d0, d1)
        near = [p for p in near if d0 - p[3] <= gap]
        for a0, a1, b0, b1 in near:
            # pieces may share a repeated word at the seam
            if a0 < i0 and b0 < d0 and a1 < i1 and b1 < d1 and i0 - a1 <= gap and i0 > a1 - run and d0 > b1 - run and i1 - a0 > own[1] - own[0]:
                own = (a0, i1, b0, d1)
        best.append(own)
        near.append(own)
    return best


def covered(found: list[tuple[int, int, int, int]]) -> int:
    """The most words of the item that one passage, or two in the item's order, make up."""
    top = max((p[1] - p[0] for p in found), default=0)
    # longest first passage by where it ends in the item, as a running maximum over a binary indexed tree
    size = max((p[1] for p in found), default=0) + 1
    tree = [0] * (size + 1)
    ended, k = sorted(found, key=lambda p: p[3]), 0
    for i0, i1, d0, _ in sorted(found, key=lambda p: p[2]):
        while k < len(ended) and ended[k][3] <= d0:
            at, length = ended[k][1] + 1, ended[k][1] - ended[k][0]
            while at <= size:
                tree[at] = max(tree[at], length)
                at += at & -at
            k += 1
        at, first = i0 + 1, 0
        while at > 0:
            first = max(first, tree[at])
            at -= at & -at
        if first:
            top = max(top, first + i1 - i0)
    return top


def leaks(documents: DataFrame, items: DataFrame, *, share: float = 0.5, run: int = 4, block_items: int = 20_000, chunk: int = 500) -> DataFrame:
    """(doc_id, item_id, share): documents that hold at least ``share`` of an item's words in one or two running passages.

    ``documents`` needs doc_id and text, ``items`` item_id and text; other columns are ignored. Null and empty
    texts have no hits; items of fewer than ``run`` words only as a whole. Repeated rows give one row. Documents are read
    and split into words once; the tables of ``block_items`` items at a time are searched for in each batch, so that a
    task holds bounded tables whatever the number of items.
    """
    spark = documents.sparkSession
    ordered = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-ordered.count() // block_items))
    shared = []
    for k in range(blocks):
        block = ordered if blocks == 1 else ordered.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        shared.append(spark.sparkContext.broadcast([(r.item_id, r.text) for r in block.distinct().collect()]))  # about block_items

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = WordSearch(shared[0].value, run) if len(shared) == 1 else None
        for pdf in batches:
            out = []
            keys, texts = pdf["doc_id"].to_numpy(), [words_of(x) for x in pdf["text"]]
            for block in shared:
                search_in = tables or WordSearch(block.value, run)
                for begin in range(0, len(pdf), chunk):
                    out += [(int(keys[begin + doc]), item, part) for doc, item, part in _hits(search_in, texts[begin : begin + chunk], share, run)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "share"])

    hits = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return hits.mapInPandas(search, "doc_id long, item_id long, share double").groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def _hits(tables: WordSearch, texts: list[list[str]], share: float, run: int) -> Iterator[tuple[int, int, float]]:
    """(text, item, share) of the items that the texts hold."""
    yield from ((doc, item, 1.0) for doc, item in tables.whole(texts))
    t, at, pattern = tables.find(texts)
    seeds: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for doc, d, p in zip(t.tolist(), at.tolist(), pattern.tolist()):
        for item, i in tables.places[p]:
            seeds[doc, item].append((i, d))
    for (doc, item), pairs in seeds.items():
        need = share * tables.lengths[item]
        # only items whose seeds can reach the share at all, with gaps between them
        if len({i for i, _ in pairs}) + 2 * (run + 4) >= need / 2 and (most := covered(passages(pairs, run))) >= need:
            yield doc, item, most / tables.lengths[item]
