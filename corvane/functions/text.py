"""Text functions as columns of the JVM; null texts give null unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Typographic characters and their plain forms, stop words, language markers, patterns of personal data.
TYPOGRAPHIC = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " ", "​": "", "﻿": ""}
STOP_WORDS = ("a", "an", "the", "of", "to", "in", "on", "at", "for", "and", "or", "is", "are", "was", "were", "be", "been", "this", "that", "these", "those", "with", "as", "by")
ENGLISH_MARKERS = ("the", "and", "of", "to", "in", "with", "was", "for", "on", "is", "no", "patient")
PERSONAL_PATTERNS = {
    "mrn": r"(?i)\b(?:mrn|medical record (?:number|no\.?))\b[:\s#]*[A-Z0-9-]{4,}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b",
    "date_of_birth": r"(?i)\b(?:dob|date of birth)\b[:\s]*\d",
    "patient_name": r"(?i)\b(?:patient name|name)\s*:\s*[A-Z][a-z]+",
    "address": r"(?i)\b\d{1,5}\s+[A-Z][a-z]+\s+(?:st|street|ave|avenue|rd|road)\b",
}
#: A line in capitals.
HEADING = r"^[A-Z][A-Z /&-]{2,}$"


def normalise(text: Column, dehyphenate: bool = True) -> Column:
    """Plain characters and line ends, no control characters, words joined over line ends, spaces collapsed."""
    for source, target in TYPOGRAPHIC.items():
        text = F.replace(text, F.lit(source), F.lit(target))
    text = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"\r\n?", "\n")
    if dehyphenate:
        text = F.regexp_replace(text, r"(\w)-[ \t]*\n\s*([a-z])", "$1$2")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(text, r"(?m)[ \t]+$", ""), F.lit(" \n\t"))


def terms(text: Column) -> Column:
    """Lower-case tokens with inner points, slashes and hyphens, without stop words; repetitions stay."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:[./-][a-z0-9]+)*)"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def token_estimate(text: Column) -> Column:
    """A token per four characters of each alphanumeric run, rounded up, and one per punctuation mark; 0 for blank."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    marks = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}_\s]"))
    return (F.aggregate(words, F.lit(0), lambda n, w: n + F.ceil(F.length(w) / 4).cast("int")) + marks).cast("long")


def language(text: Column) -> Column:
    """``en`` for at least 20 words of which 6 % or more are English markers, else null."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+)"), F.lit(1))
    hits = F.size(F.filter(words, lambda w: w.isin(*ENGLISH_MARKERS)))
    return F.when((F.size(words) >= 20) & (hits / F.size(words) >= 0.06), "en")


def personal_flags(text: Column) -> Column:
    """Sorted names of the kinds of personal data that a text's patterns show."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in sorted(PERSONAL_PATTERNS.items())]))


def garbled(text: Column) -> Column:
    """Number of control, format, private and unassigned characters and replacement marks."""
    return F.regexp_count(text, F.lit(r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}\x{FFFD}&&[^\t\n\r]]")).cast("long")


def content_digest(text: Column) -> Column:
    """Digest of a text without case and differences of white space."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


def exact_copies(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies): each document with the smallest id of its group of equal contents and the group's size.

    Documents with a null text form no group. The digest is aggregated before documents are joined to it.
    """
    d = documents.where("text is not null").select("doc_id", content_digest(F.col("text")).alias("digest"))
    groups = d.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return d.join(groups, "digest").select("doc_id", "class_id", "copies")


def furniture(documents: DataFrame, minimum_pages: int = 3, ratio: float = 0.6, longest: int = 120) -> DataFrame:
    """(doc_id, line, pages): lines that recur at the edges of a document's pages.

    Pages end at form feeds. Of each page the first and last two non-blank lines count; a line is furniture if it stands
    on at least max(2, 60 %) of the pages of a document of three pages or more.
    """
    lines = F.filter(F.transform(F.split("page", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pages = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\x0c")).alias("n", "page")).select("doc_id", "n", lines.alias("l"))
    size = F.size("l")
    edges = F.array_distinct(F.concat(F.slice("l", 1, 2), F.slice(F.col("l"), F.greatest(F.lit(1), size - 1), F.lit(2))))
    counted = pages.select("doc_id", F.count("*").over(_by_document()).alias("pages"), F.when(size > 0, edges).otherwise(F.array()).alias("e"))
    rows = counted.where(F.col("pages") >= minimum_pages).select("doc_id", "pages", F.explode("e").alias("line")).where(F.length("line") <= longest)
    return rows.groupBy("doc_id", "line").agg(F.count("*").alias("found"), F.first("pages").alias("n")).where(F.col("found") >= F.greatest(F.lit(2), F.floor(F.col("n") * ratio))).select("doc_id", "line", F.col("found").alias("pages"))


def _by_document():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id")


def headings(documents: DataFrame, longest: int = 80) -> DataFrame:
    """(doc_id, position, heading, length): sections that begin with a line in capitals, with the section's length up to the next."""
    lines = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"), F.length("text").alias("size"))
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("n")
    at = lines.withColumn("position", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = at.where(F.trim("line").rlike(HEADING) & (F.length("line") <= longest))
    return heads.select("doc_id", F.col("position").cast("long").alias("position"), F.trim("line").alias("heading"), (F.coalesce(F.lead("position").over(w), F.col("size")) - F.col("position")).cast("long").alias("length"))
