"""Quantities in different units, converted to one common unit per code.

A unit string is segmented by dynamic programming over three tries (prefixes, roots, exponents) and a
few operators. Strings such as ``M`` (metre or molar) or ``MM`` (milli- or megametre) have several
decompositions; each carries a cost from spelling and prefix priors, and the dimension that the field
is known to have decides among them. The parse works on the *distinct* (code, unit text) combinations
only; rows are converted in the JVM with exact integer arithmetic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dimensions: length, mass, time, amount of substance, temperature.
_NONE = (0, 0, 0, 0, 0)
_VOLUME, _MASS, _AMOUNT, _LENGTH, _TEMP = (3, 0, 0, 0, 0), (0, 1, 0, 0, 0), (0, 0, 0, 1, 0), (1, 0, 0, 0, 0), (0, 0, 0, 0, 1)
_PRESSURE, _CATALYTIC, _MOLAR = (-1, 1, -2, 0, 0), (0, 0, -1, 1, 0), (-3, 0, 0, 1, 0)

# Decimal prefixes with the cost of reading a clinical unit that way.
PREFIXES = {
    "": (0, 0.0), "k": (3, 0.2), "h": (2, 2.0), "da": (1, 3.0), "d": (-1, 0.2), "c": (-2, 0.2), "m": (-3, 0.2),
    "u": (-6, 0.2), "µ": (-6, 0.2), "μ": (-6, 0.2), "mc": (-6, 0.5), "n": (-9, 0.4), "p": (-12, 0.8), "f": (-15, 1.0),
    "M": (6, 4.0), "G": (9, 5.0), "T": (12, 6.0),
    "kilo": (3, 0.2), "deci": (-1, 0.2), "centi": (-2, 0.2), "milli": (-3, 0.2), "micro": (-6, 0.2), "nano": (-9, 0.2),
    "pico": (-12, 0.2), "mega": (6, 0.2),
}
# Roots as (size in SI base units, dimension, offset in kelvin, takes prefixes).
ROOTS = {
    "m": ("1", _LENGTH, "0", True), "metre": ("1", _LENGTH, "0", True), "meter": ("1", _LENGTH, "0", True),
    "in": ("0.0254", _LENGTH, "0", False), "inch": ("0.0254", _LENGTH, "0", False), "inches": ("0.0254", _LENGTH, "0", False),
    "[in_i]": ("0.0254", _LENGTH, "0", False), "ft": ("0.3048", _LENGTH, "0", False), "[ft_i]": ("0.3048", _LENGTH, "0", False),
    "foot": ("0.3048", _LENGTH, "0", False), "feet": ("0.3048", _LENGTH, "0", False), "yd": ("0.9144", _LENGTH, "0", False),
    "g": ("0.001", _MASS, "0", True), "gm": ("0.001", _MASS, "0", False), "gram": ("0.001", _MASS, "0", True), "gramme": ("0.001", _MASS, "0", True),
    "lb": ("0.45359237", _MASS, "0", False), "[lb_av]": ("0.45359237", _MASS, "0", False), "pound": ("0.45359237", _MASS, "0", False),
    "oz": ("0.028349523125", _MASS, "0", False), "[oz_av]": ("0.028349523125", _MASS, "0", False), "ounce": ("0.028349523125", _MASS, "0", False),
    "st": ("6.35029318", _MASS, "0", False), "stone": ("6.35029318", _MASS, "0", False), "[stone_av]": ("6.35029318", _MASS, "0", False),
    "t": ("1000", _MASS, "0", False), "tonne": ("1000", _MASS, "0", False),
    "l": ("0.001", _VOLUME, "0", True), "L": ("0.001", _VOLUME, "0", True), "litre": ("0.001", _VOLUME, "0", True), "liter": ("0.001", _VOLUME, "0", True),
    "ltr": ("0.001", _VOLUME, "0", True), "lt": ("0.001", _VOLUME, "0", False), "cc": ("0.000001", _VOLUME, "0", False), "ccm": ("0.000001", _VOLUME, "0", False),
    "cumm": ("0.000000001", _VOLUME, "0", False), "cu mm": ("0.000000001", _VOLUME, "0", False), "cu.mm": ("0.000000001", _VOLUME, "0", False), "cmm": ("0.000000001", _VOLUME, "0", False),
    "[foz_us]": ("0.0000295735295625", _VOLUME, "0", False), "fl oz": ("0.0000295735295625", _VOLUME, "0", False), "fl. oz": ("0.0000295735295625", _VOLUME, "0", False),
    "floz": ("0.0000295735295625", _VOLUME, "0", False), "us fl oz": ("0.0000295735295625", _VOLUME, "0", False), "fluid ounce": ("0.0000295735295625", _VOLUME, "0", False),
    "[pt_us]": ("0.000473176473", _VOLUME, "0", False), "[gal_us]": ("0.003785411784", _VOLUME, "0", False),
    "mol": ("1", _AMOUNT, "0", True), "mole": ("1", _AMOUNT, "0", True), "M": ("1000", _MOLAR, "0", True), "molar": ("1000", _MOLAR, "0", True),
    "kat": ("1", _CATALYTIC, "0", True), "katal": ("1", _CATALYTIC, "0", True),
    "U": ("1/60000000", _CATALYTIC, "0", True), "IU": ("1/60000000", _CATALYTIC, "0", True), "[IU]": ("1/60000000", _CATALYTIC, "0", True),
    "[iU]": ("1/60000000", _CATALYTIC, "0", True), "unit": ("1/60000000", _CATALYTIC, "0", False), "enzyme unit": ("1/60000000", _CATALYTIC, "0", False),
    "Pa": ("1", _PRESSURE, "0", True), "pascal": ("1", _PRESSURE, "0", True), "bar": ("100000", _PRESSURE, "0", True), "atm": ("101325", _PRESSURE, "0", False),
    "m[Hg]": ("133322.387415", _PRESSURE, "0", True), "mHg": ("133322.387415", _PRESSURE, "0", True), "m Hg": ("133322.387415", _PRESSURE, "0", True),
    "Torr": ("133.322387415", _PRESSURE, "0", False), "cm[H2O]": ("98.0665", _PRESSURE, "0", False), "cmH2O": ("98.0665", _PRESSURE, "0", False),
    "Cel": ("1", _TEMP, "273.15", False), "C": ("1", _TEMP, "273.15", False), "°C": ("1", _TEMP, "273.15", False), "degC": ("1", _TEMP, "273.15", False),
    "deg C": ("1", _TEMP, "273.15", False), "Celsius": ("1", _TEMP, "273.15", False), "degrees Celsius": ("1", _TEMP, "273.15", False), "℃": ("1", _TEMP, "273.15", False),
    "[degF]": ("5/9", _TEMP, "45967/180", False), "F": ("5/9", _TEMP, "45967/180", False), "°F": ("5/9", _TEMP, "45967/180", False), "degF": ("5/9", _TEMP, "45967/180", False),
    "deg F": ("5/9", _TEMP, "45967/180", False), "Fahrenheit": ("5/9", _TEMP, "45967/180", False), "degrees Fahrenheit": ("5/9", _TEMP, "45967/180", False), "℉": ("5/9", _TEMP, "45967/180", False),
    "K": ("1", _TEMP, "0", False), "kelvin": ("1", _TEMP, "0", False),
    "s": ("1", (0, 0, 1, 0, 0), "0", True), "sec": ("1", (0, 0, 1, 0, 0), "0", False), "min": ("60", (0, 0, 1, 0, 0), "0", False), "h": ("3600", (0, 0, 1, 0, 0), "0", False),
    "cells": ("1", _NONE, "0", False), "cell": ("1", _NONE, "0", False), "count": ("1", _NONE, "0", False),
    "thou": ("1000", _NONE, "0", False), "thousand": ("1000", _NONE, "0", False), "K#": ("1000", _NONE, "0", False), "mill": ("1000000", _NONE, "0", False), "million": ("1000000", _NONE, "0", False),
}
# Words that surround a unit in free text.
FILLERS = frozenset("a about and approx approximately as at by comment fasting in is measured of quantity reading repeat reported result sample see unit units value verified with".split())

Rational = tuple[Fraction, tuple[int, ...], Fraction]


class Trie:
    """A character trie; ``walk`` gives the values of all entries that begin at a position."""

    def __init__(self, entries: dict[str, object]):
        self.root: dict = {}
        for text, value in entries.items():
            node = self.root
            for ch in text:
                node = node.setdefault(ch, {})
            node.setdefault(None, []).append((text, value))

    def walk(self, s: str, at: int) -> Iterator[tuple[int, str, object]]:
        node = self.root
        for i in range(at, len(s) + 1):
            for text, value in node.get(None, ()):
                yield i, text, value
            if i == len(s) or s[i] not in node:
                return
            node = node[s[i]]


def _lower(entries: dict[str, object]) -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in entries.items():
        out.setdefault(k.lower(), []).append((k, v))
    return out


_PREFIX_TRIE, _ROOT_TRIE = Trie(_lower(PREFIXES)), Trie(_lower({k.rstrip("#") if k == "K#" else k: v for k, v in ROOTS.items() if k != "K#"}))
_EXPONENT_TRIE = Trie({**{str(n): n for n in range(2, 4)}, **{f"^{n}": n for n in range(-3, 4) if n}, **{f"-{n}": -n for n in range(1, 4)}, "²": 2, "³": 3, "⁻¹": -1})
_POWER_OF_TEN = re.compile(r"[x×]?\s*10\s*(?:\^|\*\*?|e)\s*([+-]?\d{1,2})|([x×]?\s*10)([⁰¹²³⁴⁵⁶⁷⁸⁹]+)", re.I)
_SUPERSCRIPT = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")


def _atoms(s: str, at: int) -> list[tuple[int, float, Fraction, tuple[int, ...], Fraction]]:
    """All single unit factors at a position: (end, cost, size, dimension, offset)."""
    out = []
    low = s.lower() if len(s.lower()) == len(s) else s
    for p_end, p_low, prefixes in _PREFIX_TRIE.walk(low, at):
        for prefix, (power, p_cost) in prefixes:
            p_case = 0.0 if s[at:p_end] == prefix else 1.0
            for r_end, r_low, roots in _ROOT_TRIE.walk(low, p_end):
                for root, (size, dim, offset, takes) in roots:
                    if prefix and not takes:
                        continue
                    cost = p_cost + p_case + (0.0 if s[p_end:r_end] == root else 1.0)
                    if len(root) > 3 and s[p_end:r_end].lower() == root.lower():
                        cost = p_cost + p_case * (len(prefix) < 3)
                    value = Fraction(size) * Fraction(10) ** power
                    ends = [(r_end, cost, 1)]
                    if root[-1].isalpha() and low[r_end : r_end + 1] == "s":
                        ends.append((r_end + 1, cost + 0.3, 1))
                    ends += [(e_end, cost + 0.1, n) for e_end, _, n in _EXPONENT_TRIE.walk(s, r_end) if e_end > r_end]
                    for end, c, n in ends:
                        if end < len(s) and s[end].isalpha() and s[end - 1].isalpha():
                            continue
                        out.append((end, c, value**n, tuple(x * n for x in dim), Fraction(offset) if n == 1 else Fraction(0)))
    if low[at : at + 1] == "k" and not low[at + 1 : at + 2].isalpha():  # K/uL: thousands
        out.append((at + 1, 0.6, Fraction(1000), _NONE, Fraction(0)))
    if m := _POWER_OF_TEN.match(s, at):
        out.append((m.end(), 0.2, Fraction(10) ** int(m.group(1) or m.group(3).translate(_SUPERSCRIPT)), _NONE, Fraction(0)))
    elif m := re.compile(r"1(?:0{1,6}|(?=\s*[/a-zA-Z]))").match(s, at):
        out.append((m.end(), 0.3, Fraction(int(m.group())), _NONE, Fraction(0)))
    return out


_OPERATORS = re.compile(r"\s*(?:(/)|\b(per)\b|([.·*×x])|(\s))\s*", re.I)


@lru_cache(maxsize=100_000)
def segmentations(text: str, free: bool = False) -> tuple[tuple[float, Fraction, tuple[int, ...], Fraction], ...]:
    """Decompositions of a unit string with their costs, the cheapest per meaning.

    ``free`` allows words around the unit expression, as in ``reported in mg/dL``.
    """
    s = text.strip()
    n = len(s)
    # best[position]: {(phase, sign, size, dimension, offset): cost}; phases: 0 before, 1 an operator was read, 2 a factor was read, 3 after
    best: list[dict] = [{} for _ in range(n + 1)]
    best[0][(0, 1, Fraction(1), _NONE, Fraction(0))] = 0.0

    def put(at: int, key: tuple, cost: float) -> None:
        if cost < best[at].get(key, 1e9):
            best[at][key] = cost

    for at in range(n):
        if not best[at]:
            continue
        boundary = at == 0 or not (s[at - 1].isalpha() and s[at].isalpha())
        atoms = _atoms(s, at) if boundary else []
        word = re.compile(r"[^\W\d_]+\.?").match(s, at)
        op = _OPERATORS.match(s, at)
        for (phase, sign, size, dim, offset), cost in sorted(best[at].items(), key=lambda x: x[1]):
            if phase < 2:
                for end, c, value, d, o in atoms:
                    new = tuple(a + sign * b for a, b in zip(dim, d))
                    put(end, (2, 1, size * value**sign, new, o if phase == 0 and not any(dim) else Fraction(0)), cost + c)
                    if s[end - 1].isdigit() and s[end : end + 1].isalpha():  # a number before its unit, as in g/100mL
                        put(end, (1, sign, size * value**sign, new, Fraction(0)), cost + c + 0.1)
                if phase == 0 and op and (op.group(1) or op.group(2)):
                    put(op.end(), (1, -1, size, dim, offset), cost + 0.2)
            elif phase == 2:
                if op:
                    minus = bool(op.group(1) or op.group(2))
                    put(op.end(), (1, -1 if minus else 1, size, dim, offset), cost + (0.1 if minus else 0.6))
                if s[at] == "%":
                    put(at + 1, (2, 1, size / Fraction("0.0001"), tuple(a - b for a, b in zip(dim, _VOLUME)), Fraction(0)), cost + 0.3)
            if (phase in (0, 3) or phase == 2 and free) and boundary:
                outside = 3 if phase else 0
                if not s[at].isalnum():
                    put(at + 1, (outside, sign, size, dim, offset), cost + (0.05 if free or s[at] in "[]() ." else 1.0))
                elif free and word:
                    known = word.group().lower().rstrip(".") in FILLERS
                    put(word.end(), (outside, sign, size, dim, offset), cost + (0.4 if known else 3.0))
                elif free and s[at].isdigit():
                    put(at + 1, (outside, sign, size, dim, offset), cost + 3.0)
            if phase == 2 and not free and s[at] in ".":
                put(at + 1, (2, 1, size, dim, offset), cost + 0.1)
    merged: dict[tuple, float] = {}
    for (phase, _, size, dim, offset), cost in best[n].items():
        if phase >= 2 and cost < merged.get((size, dim, offset), 1e9):
            merged[(size, dim, offset)] = cost
    return tuple(sorted(((c, *k) for k, c in merged.items()), key=lambda x: (x[0], x[1])))


# What a mismatch with the field's dimension costs.
SAME_DIMENSION, BY_MOLAR_MASS = 0.0, 0.5


def conversion(text: str, common: str, molar_mass: float | None, free: bool) -> tuple[int, int, int, bool] | None:
    """(a, b, d, same): a value in the unit of ``text`` is (a*value + b)/d of ``common``; None if it can't be read.

    ``same`` tells that both have the same size. ``molar_mass`` (g/mol) joins mass with amount.
    """
    target = next(iter(segmentations(common)), None)
    if target is None or not text or not text.strip():
        return None
    _, t_size, t_dim, t_offset = target
    molar = Fraction(str(molar_mass)) / 1000 if molar_mass and molar_mass == molar_mass else None
    choices = []
    for cost, size, dim, offset in segmentations(text, free):
        if dim == t_dim:
            choices.append((cost + SAME_DIMENSION, size / t_size, (offset - t_offset) / t_size))
        elif molar and dim == tuple(x + y - z for x, y, z in zip(t_dim, _MASS, _AMOUNT)):
            choices.append((cost + BY_MOLAR_MASS, size / molar / t_size, Fraction(0)))
        elif molar and dim == tuple(x - y + z for x, y, z in zip(t_dim, _MASS, _AMOUNT)):
            choices.append((cost + BY_MOLAR_MASS, size * molar / t_size, Fraction(0)))
    if not choices:
        return None
    _, factor, shift = min(choices, key=lambda x: x[0])
    d = factor.denominator * shift.denominator
    return int(factor * d), int(shift * d), d, factor == 1 and shift == 0


_NUMBER = r"[-+]?\d(?:[\d,]*\d)?(?:\.\d+)?"


def _number_text(text: Column) -> Column:
    """The first number of a text; digits that begin a power of ten (10^9) belong to the unit."""
    return F.regexp_extract(text, rf"(?:^|[^\d.,])({_NUMBER}(?=\s*[x×]?\s*10[\^*])|{_NUMBER}(?![\^*\d]))", 1)


def _plain(number: Column) -> Column:
    """A number text as double: 1,234 groups thousands; 0,123 or 12,5 has a decimal comma."""
    grouped = number.rlike(r"^[-+]?[1-9]\d{0,2}(,\d{3})+(\.\d+)?$")
    return F.when(grouped, F.regexp_replace(number, ",", "")).otherwise(F.regexp_replace(number, ",", ".")).try_cast("double")


def convert_quantities(facts: DataFrame, code_unit: DataFrame, passthrough: list[str]) -> DataFrame:
    """Every readable quantity in the common unit of its code.

    ``facts`` needs code_key, value, unit, value_text; further columns of ``passthrough`` are kept, others
    are not read. Adds ``number`` (value as sent), ``milli`` (in the common unit times 1000, half up), ``same``
    (unit of the same size) and ``from_text`` (the unit stands only in value_text). Rows whose value, unit
    or code is missing or can't be read are left out: nulls, NaN, infinities, blank units, codes without a common
    unit, and results beyond 64 bits. Values keep all their digits, however small or large they are.
    Repeated rows stay repeated. An empty table gives an empty result.
    """
    blank = F.col("unit").isNull() | (F.trim("unit") == "")
    text = F.col("value_text")
    base = facts.select(
        *passthrough, F.col("code_key").alias("_code"), blank.alias("from_text"),
        F.when(F.col("value").isNotNull(), F.col("value")).otherwise(_plain(_number_text(text))).alias("number"),
        F.when(~blank, F.col("unit")).otherwise(
            F.when(F.col("value").isNotNull(), text).otherwise(F.regexp_replace(text, rf"^(.*?)(?<![\d.,])(?:{_NUMBER})(?:(?=\s*[x×]?\s*10[\^*])|(?![\^*\d]))", "$1 "))
        ).alias("_unit"),
    ).where(F.col("number").isNotNull() & ~F.isnan("number") & (F.abs("number") < float("inf")) & F.col("_unit").isNotNull())
    known = base.select("_code", "_unit", "from_text").distinct().join(code_unit.select(F.col("code_key").alias("_code"), "common_unit", "molar_mass"), "_code")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                c = conversion(r._asdict()["unit_text"], r.common_unit, r.molar_mass, r.from_text)
                if c and max(abs(c[0]), abs(c[1]), c[2]) < 10**18:
                    rows.append((r.code, r.unit_text, r.from_text, *map(int, c[:3]), c[3]))
            yield pd.DataFrame(rows, columns=["_code", "_unit", "from_text", "_a", "_b", "_d", "same"])

    rules = known.select(F.col("_code").alias("code"), F.col("_unit").alias("unit_text"), "from_text", "common_unit", "molar_mass").mapInPandas(
        parse, "_code string, _unit string, from_text boolean, _a long, _b long, _d long, same boolean"
    )
    a, b, d = (F.col(c).cast("decimal(18,0)") for c in ("_a", "_b", "_d"))
    eight, two, two_thousand = F.lit(10**8).cast("decimal(9,0)"), F.lit(2).cast("decimal(1,0)"), F.lit(2000).cast("decimal(4,0)")
    joined = base.join(rules, ["_code", "_unit", "from_text"]).select(*passthrough, "number", "same", "from_text", "_a", "_b", "_d", F.col("number").try_cast("decimal(20,8)").alias("_short"))

    def divided(n: Column, m: Column) -> Column:
        """Half up, given twice the numerator plus the denominator, and twice the denominator."""
        q = F.call_function("div", n, m)
        return q - F.when((n < 0) & (n % m != 0), 1).otherwise(0)

    # nearly all values have at most eight decimals
    scaled = (F.col("_short") * eight).cast("decimal(20,0)")
    usual = divided((scaled * a + b * eight) * two_thousand + d * eight, d * eight * two)
    # the others: the digits of the shortest decimal form as a whole number, and the power of ten they are divided by
    text_form = F.abs("number").cast("string")
    mantissa = F.split_part(text_form, F.lit("E"), F.lit(1))
    scale = F.length(F.split_part(mantissa, F.lit("."), F.lit(2))) - F.coalesce(F.nullif(F.split_part(text_form, F.lit("E"), F.lit(2)), F.lit("")).try_cast("int"), F.lit(0))
    digits = F.replace(mantissa, F.lit("."), F.lit("")).try_cast("decimal(20,0)") * F.when(F.col("number") < 0, -1).otherwise(1).cast("decimal(1,0)")

    def power(exponent: Column) -> Column:
        return F.rpad(F.lit("1"), F.greatest(exponent, F.lit(0)) + 1, "0").try_cast("decimal(38,0)")

    def times(*factors: Column) -> Column:  # null where 38 digits don't hold the product
        return reduce(F.try_multiply, factors)

    below = times(d, power(scale))
    top = F.try_add(F.try_add(times(digits, power(-scale), a, two_thousand), times(b, power(scale), two_thousand)), below)
    rounded = F.when(F.abs("number") < 1e300, F.floor((F.col("_a") * F.col("number") + F.col("_b")) / F.col("_d") * 1000 + 0.5))  # of 15 digits
    short = F.col("_short").isNotNull() & (F.abs("number") < 1e11) & (F.col("_short").cast("double") == F.col("number"))
    milli = F.when(short, usual.try_cast("long")).otherwise(F.coalesce(divided(top, times(below, two)).try_cast("long"), rounded.try_cast("long")))
    out = joined.withColumn("milli", milli).where("milli is not null")
    return out.select(*passthrough, "number", "same", "from_text", "milli")


def observations_to_convert(facts: DataFrame, code_unit: DataFrame) -> DataFrame:
    """(observation_key, value_milli), distinct: observations whose unit differs in size from the common one or stands only in value_text."""
    done = convert_quantities(facts, code_unit, ["observation_key"])
    return done.where(~F.col("same") | F.col("from_text")).select("observation_key", F.col("milli").alias("value_milli")).distinct()
