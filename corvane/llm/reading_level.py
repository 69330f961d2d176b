"""Reading level of documents by smoothed unigram language models.

One language model per band is trained on a bounded sample of labelled texts; bands without labels are
seeded by a readability formula. After a first fit, labelled texts that clearly fit another band better
(wrong labels) are left out and the models are fitted again. A document gets the band with the highest
posterior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: The scale of the labels, from least to most demanding.
BANDS = ("easy", "medium", "hard")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_VOWELS = re.compile(r"[aeiouyäöüáéíóúàèìòùâêîôûå]+")
_SENTENCE = re.compile(r"[.!?]+(?:\s|$)|\n+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if isinstance(text, str) else []


def grade(text: str) -> float:
    """Flesch-Kincaid grade from words per sentence and vowel groups per word."""
    words = words_of(text)
    sentences = max(1, sum(bool(words_of(s)) for s in _SENTENCE.split(text)))
    if not words:
        return 0.0
    syllables = sum(max(1, len(_VOWELS.findall(w))) for w in words)
    return 0.39 * len(words) / sentences + 11.8 * syllables / len(words) - 15.59


def formula_band(text: str) -> str:
    """Fixed thresholds on the grade: school reading up to 6, professional notes up to 14, scientific prose beyond."""
    g = grade(text)
    return BANDS[0] if g < 6 else BANDS[1] if g < 14 else BANDS[2]


class BandModels:
    """Unigram models with interpolated smoothing against the words of all bands."""

    def __init__(self, texts: list[list[str]], bands: list[str], background: float = 0.02):
        self.names = BANDS
        counts: dict[str, np.ndarray] = {}
        for words, band in zip(texts, bands):
            k = BANDS.index(band)
            for w in words:
                if (row := counts.get(w)) is None:
                    counts[w] = row = np.zeros(len(BANDS))
                row[k] += 1
        kept = sorted(counts, key=lambda w: (-counts[w].sum(), w))
        self.words = {w: i for i, w in enumerate(kept)}
        table = np.array([counts[w] for w in kept]).reshape(-1, len(BANDS)).T + 0.0
        total = np.maximum(table.sum(1, keepdims=True), 1)
        everywhere = (table.sum(0) + 0.5) / (table.sum() + 0.5 * max(1, table.shape[1]))
        # a word unknown to a band falls back to its share over all bands, a word unknown to all changes nothing
        self.logs = np.log((1 - background) * table / total + background * everywhere)
        seen = np.array([bands.count(b) for b in BANDS], float)
        self.prior = np.log((seen + 1) / (seen.sum() + len(BANDS)))

    def scores(self, words: list[str]) -> np.ndarray:
        """Log posterior of the bands up to a constant; without a known word the prior."""
        at = [i for w in words if (i := self.words.get(w)) is not None]
        return self.prior + (self.logs[:, at].sum(1) if at else 0)

    def band(self, words: list[str]) -> str:
        return BANDS[int(np.argmax(self.scores(words)))]


def fit_models(texts: list[str], bands: list[str]) -> BandModels:
    """Models after one round that leaves out labels which another band beats clearly.

    A label counts as wrong if cross-fitted models of the other fifths prefer another band by more than 0.1 per word.
    """
    words = [words_of(t) for t in texts]
    keep = np.ones(len(texts), bool)
    for fold in range(5):
        train = [i for i in range(len(texts)) if i % 5 != fold]
        if not {bands[i] for i in train} >= set(bands) or len(train) < 10:
            break
        models = BandModels([words[i] for i in train], [bands[i] for i in train])
        for i in range(fold, len(texts), 5):
            s = models.scores(words[i])
            keep[i] = s.max() - s[BANDS.index(bands[i])] <= 0.1 * max(1, len(words[i]))
    rows = np.flatnonzero(keep) if set(np.array(bands, object)[keep]) == set(bands) else np.arange(len(texts))
    return BandModels([words[i] for i in rows], [bands[i] for i in rows])


def training_texts(documents: DataFrame, labels: DataFrame, max_texts: int) -> list[tuple[str, str]]:
    """At most ``max_texts`` labelled texts, chosen by a hash of the id, and formula-seeded ones for bands without label."""
    one = labels.where(F.col("band").isin(*BANDS)).groupBy("doc_id").agg(F.mode("band", deterministic=True).alias("band"))
    docs = documents.where("lang = 'en' and text is not null and trim(text) <> ''").select("doc_id", "text")
    chosen = docs.join(one, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "band").limit(max_texts)
    rows = [(r.text, r.band) for r in chosen.select("text", "band").collect()]  # bounded by max_texts
    if missing := set(BANDS) - {b for _, b in rows}:
        sample = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_texts).collect()
        rows += [(r.text, b) for r in sample if (b := formula_band(r.text)) in missing]
    return rows


def reading_levels(documents: DataFrame, labels: DataFrame, max_texts: int = 5_000) -> DataFrame:
    """(doc_id, band, margin): each English document with the band of highest posterior; margin is its lead per word.

    The models are fitted on at most ``max_texts`` labelled texts, that is the bound of the classifier's sample; every
    document is scored whole. A document without a known word (empty, null or only numbers) gets the commonest band
    and margin 0. Documents of another or a null language are left out; repeated rows stay repeated.
    """
    spark = documents.sparkSession
    rows = training_texts(documents, labels, max_texts)
    models = spark.sparkContext.broadcast(fit_models([t for t, _ in rows], [b for _, b in rows]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = models.value
        for pdf in batches:
            bands, margins = [], []
            for text in pdf["text"]:
                words = words_of(text)
                s = m.scores(words)
                top = np.sort(s)
                bands.append(BANDS[int(np.argmax(s))])
                margins.append(float(top[-1] - top[-2]) / max(1, len(words)) if words else 0.0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "band": bands, "margin": margins})

    english = documents.where("lang = 'en' and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return english.mapInPandas(score, "doc_id long, band string, margin double")


def corpus_profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, band, documents, chars) of the English documents."""
    scored = materialize(reading_levels(documents, labels), "levels").groupBy("doc_id").agg(F.first("band").alias("band"))
    return documents.join(scored, "doc_id").groupBy("source", "band").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


