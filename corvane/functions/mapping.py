"""Transforms from message fields to typed values, as columns. What can't be mapped is null, with the reason beside it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accepted form of a message timestamp and of an offset; codes of administrative sex; words for true and false.
_TIMESTAMP = r"^(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:\.\d+)?([+-]\d{4})?$"
_OFFSET = r"^(Z|[+-]\d{2}:\d{2})$"
SEX = {"M": "male", "F": "female", "O": "other", "A": "other", "N": "other", "U": "unknown", "": "unknown"}
TRUE_WORDS, FALSE_WORDS = ("Y", "YES", "1", "TRUE"), ("N", "NO", "0", "FALSE")


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def message_time(value: Column, want: str = "dateTime", timezone: str | None = None) -> Column:
    """A message timestamp at the precision it was sent with: ``2026``, ``2026-03``, ``2026-03-20`` or with time and offset.

    ``want`` is ``date``, ``dateTime`` or ``instant``. A time without offset takes ``timezone`` (``Z`` or ``+HH:MM``); without
    one it is null, as no offset is assumed. Blank, null and malformed values are null.
    """
    if timezone and not re.match(_OFFSET, timezone):
        raise ValueError(f"{timezone} is no offset")
    text = F.trim(value)
    part = lambda k: _blank_to_null(F.regexp_extract(text, _TIMESTAMP, k))
    day = F.concat_ws("-", part(1), part(2), F.when(part(2).isNotNull(), part(3)))
    offset = F.regexp_replace(part(7), r"^(...)(..)$", "$1:$2")
    zone = F.coalesce(offset, F.lit(timezone) if timezone else F.lit(None).cast("string"))
    clock = F.concat(day, F.lit("T"), part(4), F.lit(":"), F.coalesce(part(5), F.lit("00")), F.lit(":"), F.coalesce(part(6), F.lit("00")), zone)
    whole = day if want == "date" else F.when(part(4).isNull() | part(3).isNull(), day).otherwise(clock)
    return F.when(part(1).isNotNull(), whole)


def code_lookup(value: Column, codes: dict[str, str], passthrough: bool = False) -> Column:
    """The code that a table declares for ``value``; null for an unknown one, or the value itself with ``passthrough``."""
    found = reduce(lambda c, kv: c.when(value == kv[0], kv[1]), list(codes.items())[1:], F.when(value == next(iter(codes)), codes[next(iter(codes))])) if codes else F.lit(None).cast("string")
    return F.coalesce(found, _blank_to_null(value)) if passthrough else found


def sex(value: Column) -> Column:
    """Administrative sex; unknown for blank, null and unrecognised codes."""
    return F.coalesce(code_lookup(F.upper(F.trim(value)), SEX), F.lit("unknown"))


def boolean(value: Column, true: tuple[str, ...] = TRUE_WORDS, false: tuple[str, ...] = FALSE_WORDS) -> Column:
    word = F.upper(F.trim(value))
    return F.when(word.isin(*true), True).when(word.isin(*false), False)


def decimal(value: Column) -> Column:
    """Numeric text as a number; null for anything else, such as ``<0.5``."""
    return F.trim(value).try_cast("double")


def reference(value: Column, resource_type: str, prefix: str = "") -> Column:
    """``Type/id`` of an identifier: other characters than letters, digits, point and hyphen become hyphens, 64 at most."""
    return F.when(F.trim(value) != "", F.concat(F.lit(f"{resource_type}/"), F.substring(F.regexp_replace(F.concat(F.lit(prefix), F.trim(value)), r"[^A-Za-z0-9\-.]", "-"), 1, 64)))


#: The transforms by name; each takes the value and its parameters.
TRANSFORMS: dict[str, Callable[..., Column]] = {
    "identity": lambda v: _blank_to_null(v), "trim": lambda v: _blank_to_null(F.trim(v)), "upper": lambda v: _blank_to_null(F.upper(F.trim(v))),
    "constant": lambda v, value=None: F.lit(value), "code_lookup": code_lookup, "sex": sex, "boolean": boolean, "decimal": decimal, "reference": reference,
    "date": lambda v: message_time(v, "date"), "datetime": lambda v, timezone=None: message_time(v, "dateTime", timezone), "instant": lambda v, timezone=None: message_time(v, "instant", timezone),
}


def map_fields(rows: DataFrame, rules: dict[str, tuple[str, str, dict]], keep: list[str]) -> DataFrame:
    """``keep``, one column per target, and ``unmapped``: the targets whose source is filled but maps to nothing.

    ``rules`` gives for each target (source column, transform, parameters). An unknown transform is refused.
    """
    columns, failed = [], []
    for target, (source, transform, parameters) in rules.items():
        if transform not in TRANSFORMS:
            raise ValueError(f"unknown transform {transform}")
        made = TRANSFORMS[transform](F.col(source), **parameters)
        columns.append(made.alias(target))
        failed.append(F.when(made.isNull() & (F.trim(source) != ""), F.lit(target)))
    return rows.select(*keep, *columns, F.array_compact(F.array(*failed)).alias("unmapped"))
