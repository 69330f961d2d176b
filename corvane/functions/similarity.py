"""Similarities of names and dates, and the weights they carry in record comparison."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler_value(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro similarity raised by a common prefix of at most four characters; 1 if equal, 0 if only one is empty."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, order = [False] * len(b), []
    for i, ch in enumerate(a):
        k = next((k for k in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[k] and b[k] == ch), None)
        if k is not None:
            taken[k] = True
            order.append(ch)
    n = len(order)
    if not n:
        return 0.0
    moved = sum(x != y for x, y in zip(order, (c for c, t in zip(b, taken) if t))) // 2
    jaro = (n / len(a) + n / len(b) + (n - moved) / n) / 3
    prefix = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return jaro + prefix * scale * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity of two columns; null if either is null. Repeated pairs of a batch are computed once."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if (v := known.get((x, y))) is None:
            known[x, y] = v = jaro_winkler_value(x, y)
        out.append(v)
    return pd.Series(out, dtype="float64")


def date_similarity(a: Column, b: Column) -> Column:
    """1 equal, 0.8 day and month swapped, 0.55 same year and month, or same day within a year, else 0."""
    same_month = (F.year(a) == F.year(b)) & (F.month(a) == F.month(b))
    swapped = (F.year(a) == F.year(b)) & (F.month(a) == F.dayofmonth(b)) & (F.dayofmonth(a) == F.month(b))
    near_year = (F.month(a) == F.month(b)) & (F.dayofmonth(a) == F.dayofmonth(b)) & (F.abs(F.year(a) - F.year(b)) == 1)
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when(swapped, 0.8).when(same_month | near_year, 0.55).otherwise(0.0)


def weight(similarity: Column, m: float, u: float, full: float = 0.92, none: float = 0.70) -> Column:
    """log2 weight of an observed similarity, linear between the two thresholds; null counts 0."""
    if not 0 < u < m < 1:
        raise ValueError("probabilities need 0 < u < m < 1")
    agree, differ = math.log2(m / u), math.log2((1 - m) / (1 - u))
    part = (similarity - none) / (full - none)
    return F.when(similarity.isNull(), 0.0).when(similarity >= full, agree).when(similarity <= none, differ).otherwise(differ + part * (agree - differ))


def zone(total: Column, upper: float = 16.0, lower: float = 6.0) -> Column:
    return F.when(total >= upper, "match").when(total <= lower, "non_match").otherwise("review")
