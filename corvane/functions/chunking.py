"""Sentences and section-aware chunks of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Abbreviations whose point ends no sentence, and the sizes of a chunk in estimated tokens.
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "pt", "prof", "st", "vs", "approx", "e.g", "i.e", "cf", "q.i.d", "b.i.d", "t.i.d", "no", "fig")
TARGET, LEAST, MOST, OVERLAP = 384, 64, 512, 0.12

_END = re.compile(r"(?<=[.!?])[ \t]+(?=[\"'(\[]?[A-Z0-9])")
_WORD = re.compile(r"[^\W_]+|[^\w\s]")
_HEADING = re.compile(r"[A-Z][A-Z /&-]{2,}")


def tokens_of(text: str) -> int:
    return sum(-(-len(w) // 4) if w.isalnum() else 1 for w in _WORD.findall(text))


def sentences(text: str) -> list[str]:
    """Sentences of one line; points of abbreviations, initials and decimals end none."""
    out: list[str] = []
    for part in _END.split(text):
        last = out[-1].rsplit(None, 1)[-1].lower() if out else ""
        if out and (last.rstrip(".") in ABBREVIATIONS or re.fullmatch(r"[a-z]\.", last)):
            out[-1] += " " + part
        else:
            out.append(part)
    return [s for s in out if s.strip()]


def sentence_count(text: Column) -> Column:
    """Number of sentences of a text; 0 for null and blank ones."""

    @F.pandas_udf("long")
    def count(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: sum(len(sentences(line)) for line in t.split("\n")) if isinstance(t, str) else 0).astype("int64")

    return count(text)


def chunks(text: str | None) -> Iterator[tuple[str, str, int]]:
    """(heading, chunk, tokens): a chunk stays within its section and repeats about an eighth of the one before; tables aren't cut within a row."""
    heading, pieces = "", []

    def close() -> Iterator[tuple[str, str, int]]:
        held, size = [], 0
        for piece in pieces:
            n = tokens_of(piece)
            if held and size + n > TARGET and (size >= LEAST or size + n > MOST):
                yield heading, "\n".join(held), size
                keep, room = [], int(size * OVERLAP)
                for h in reversed(held):
                    if tokens_of(h) > room:
                        break
                    keep.insert(0, h)
                    room -= tokens_of(h)
                held, size = keep, sum(map(tokens_of, keep))
            held.append(piece)
            size += n
        if held:
            yield heading, "\n".join(held), size

    for line in (text or "").split("\n"):
        s = line.strip()
        if _HEADING.fullmatch(s) and len(s) <= 80:
            yield from close()
            heading, pieces = s, []
        elif s:
            pieces += [s] if "|" in s else sentences(s)
    yield from close()


def chunk(documents: DataFrame) -> DataFrame:
    """(doc_id, position, heading, chunk, tokens) of (doc_id, text); null and blank texts have no chunks. A single longer sentence stays whole."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *c) for k, t in zip(pdf["doc_id"], pdf["text"]) for i, c in enumerate(chunks(t if isinstance(t, str) else None))]
            yield pd.DataFrame(rows, columns=["doc_id", "position", "heading", "chunk", "tokens"])

    return documents.select("doc_id", "text").mapInPandas(cut, "doc_id long, position long, heading string, chunk string, tokens long")
