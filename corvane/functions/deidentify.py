"""De-identification as columns of the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three-digit postal areas with too few inhabitants to publish.
RESTRICTED_PREFIXES = ("036", "059", "102", "202", "203", "204", "205", "369", "556", "692", "753", "772", "821", "823", "878", "879", "884", "893")


def pseudonym(value: Column, salt: str, prefix: str = "") -> Column:
    """A salted digest of 128 bits as hexadecimal text; null stays null. An empty salt is refused."""
    if not salt:
        raise ValueError("a salt is needed")
    digest = F.substring(F.sha2(F.concat(F.lit(salt + "|"), value.cast("string")), 256), 1, 32)
    return F.concat(F.lit(prefix + "_"), digest) if prefix else digest


def age_band(age: Column) -> Column:
    """Five-year bands up to 89, then 90+; unknown for a missing or negative age."""
    low = (F.floor(age / 5) * 5).cast("int")
    return F.when(age.isNull() | (age < 0), "unknown").when(age >= 90, "90+").otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string")))


def cohort_prefix(postal: Column) -> Column:
    """The first three digits, ``suppressed`` for restricted areas and ``unknown`` without digits."""
    digits = F.regexp_replace(F.coalesce(postal, F.lit("")), r"\D", "")
    first = F.substring(digits, 1, 3)
    return F.when(digits == "", "unknown").when(first.isin(*RESTRICTED_PREFIXES), "suppressed").otherwise(first)


def year_only(date: Column) -> Column:
    """A date or partial date cut to its year."""
    return F.nullif(F.regexp_extract(date.cast("string"), r"^(\d{4})", 1), F.lit(""))
