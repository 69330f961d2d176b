"""Document processing: type, effective date, title, furniture removal, quality verdict and the metadata record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import HEADING, furniture, garbled, language, personal_flags

# Words that speak for a type, with their weight; the least sum that is trusted.
TYPE_EVIDENCE = {
    "radiology_report": {"findings": 2.0, "impression": 1.5, "technique": 2.0, "contrast": 1.5, "radiology report": 4.0, "comparison": 1.5, "ct scan": 2.0, "mri": 2.0, "radiograph": 2.0},
    "trial_protocol": {"inclusion criteria": 3.5, "exclusion criteria": 3.5, "primary endpoint": 3.0, "secondary endpoint": 2.5, "study protocol": 4.0, "informed consent": 2.0, "randomiz": 2.0},
    "adverse_event_report": {"adverse event": 4.0, "serious adverse": 3.5, "suspected reaction": 3.0, "causality": 2.5, "meddra": 3.0, "pharmacovigilance": 3.0},
    "guideline": {"recommendation": 2.5, "class of recommendation": 3.5, "level of evidence": 3.5, "clinical practice guideline": 4.0, "grade of evidence": 3.0},
    "literature": {"abstract": 2.5, "methods": 1.5, "references": 2.0, "doi": 2.5, "pubmed": 2.5, "we conducted": 2.0},
}
LEAST_EVIDENCE = 4.0
# Labels of an effective date, and the years that are plausible.
DATE_LABEL = r"(?i)(?:date of service|service date|date|admitted|admission date|discharge date|collected|reported|examination date|study date|visit date)[:\s]*$"
FIRST_YEAR, LAST_YEAR = 1900, 2100
_MONTHS = "January February March April May June July August September October November December".split()


def type_scores(text: Column, sections: Column, evidence: dict[str, dict[str, float]] = TYPE_EVIDENCE) -> dict[str, Column]:
    """The evidence for each type: the weights of the words that occur, half as much again if a section heading has them."""
    low, headings = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(sections, F.lit("")))
    one = lambda term, w: F.when(F.contains(low, F.lit(term)), w).otherwise(0.0) + F.when(F.contains(headings, F.lit(term)), w / 2).otherwise(0.0)
    return {t: reduce(lambda a, b: a + b, [one(*x) for x in terms.items()]) for t, terms in evidence.items()}


def classify(text: Column, sections: Column, evidence: dict[str, dict[str, float]] = TYPE_EVIDENCE) -> Column:
    """struct(type, confidence): the type of most evidence, ties by the order of ``evidence``; ``unknown`` below the least sum.

    The confidence grows from 0.5 to 1 with the lead over the second type. Null and empty texts are unknown with 0.
    """
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.round(s, 4).alias("score"), F.lit(-k).alias("order"), F.lit(t).alias("type")) for k, (t, s) in enumerate(type_scores(text, sections, evidence).items())])))
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    sure = best.score >= LEAST_EVIDENCE
    lead = (best.score - F.coalesce(second.score, F.lit(0.0))) / best.score
    return F.struct(F.when(sure, best.type).otherwise("unknown").alias("type"), F.round(F.when(sure, 0.5 + 0.5 * lead).otherwise(best.score / LEAST_EVIDENCE), 4).alias("confidence"))


def effective_date(text: Column) -> Column:
    """The latest date that a label precedes, else the first plausible one by form (2026-03-20, 3/20/2026, March 20, 2026); null without any."""
    forms = [
        (r"\b(\d{4}-\d{2}-\d{2})\b", lambda d: d),
        (r"\b(\d{1,2}/\d{1,2}/\d{4})\b", lambda d: F.concat_ws("-", F.split_part(d, F.lit("/"), F.lit(3)), F.lpad(F.split_part(d, F.lit("/"), F.lit(1)), 2, "0"), F.lpad(F.split_part(d, F.lit("/"), F.lit(2)), 2, "0"))),
        (rf"(?i)\b((?:{'|'.join(_MONTHS)})\s+\d{{1,2}},?\s+\d{{4}})\b", lambda d: F.concat_ws("-", F.regexp_extract(d, r"(\d{4})$", 1), F.lpad(_month_number(d), 2, "0"), F.lpad(F.regexp_extract(d, r"\s(\d{1,2}),?\s", 1), 2, "0"))),
    ]
    found = []
    for pattern, iso in forms:
        dates = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        # the label stands in the forty characters before the date
        before = F.slice(F.split(text, pattern), F.lit(1), F.greatest(F.size(dates), F.lit(0)))
        found.append(F.transform(F.arrays_zip(dates.alias("d"), before.alias("before")), _dated(iso)))
    every = F.filter(F.concat(*found), lambda x: F.year(x.day).between(FIRST_YEAR, LAST_YEAR))
    labelled = F.array_max(F.transform(F.filter(every, lambda x: x.labelled), lambda x: x.day))
    return F.coalesce(labelled, F.get(F.filter(every, lambda x: ~x.labelled), F.lit(0)).day)


def _month_number(d: Column) -> Column:
    name = F.lower(F.regexp_extract(d, r"^([A-Za-z]+)", 1))
    return reduce(lambda c, kv: c.when(name == kv[1].lower(), str(kv[0])), list(enumerate(_MONTHS, 1)), F.when(F.lit(False), "0"))


def _dated(iso):
    return lambda x: F.struct(iso(x.d).try_cast("date").alias("day"), F.coalesce(F.rtrim(F.right(x.before, F.lit(40))).rlike(DATE_LABEL), F.lit(False)).alias("labelled"))


def title(text: Column, headings: Column, filename: Column) -> Column:
    """The first line of 8 to 160 characters that is no section heading, else the first heading, else the file name."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    own = F.get(F.filter(lines, lambda x: F.length(x).between(8, 160) & ~x.rlike(HEADING)), F.lit(0))
    return F.coalesce(own, F.get(headings, F.lit(0)), filename)


def section_headings(text: Column) -> Column:
    """The lines of a text that are section headings, in order, each once."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(lines, lambda x: x.rlike(HEADING) & (F.length(x) <= 80)))


def without_furniture(documents: DataFrame) -> DataFrame:
    """(doc_id, text, removed_lines): the documents without the lines that recur as page furniture; nulls stay null."""
    found = furniture(documents).groupBy("doc_id").agg(F.collect_set("line").alias("_lines"))
    d = documents.select("doc_id", "text").join(found, "doc_id", "left")
    lines = F.split("text", "\n")
    plain = lambda x: F.trim(F.replace(x, F.lit("\x0c"), F.lit("")))
    recurs = lambda x: F.array_contains(F.col("_lines"), plain(x))
    # a page's end stays where its first line goes
    kept = F.array_compact(F.transform(lines, lambda x: F.when(~recurs(x), x).when(F.contains(x, F.lit("\x0c")), F.lit("\x0c"))))
    clean = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return d.select("doc_id", clean.alias("text"), F.when(F.col("_lines").isNull(), 0).otherwise(F.size(F.filter(lines, recurs))).cast("long").alias("removed_lines"))


def metadata(documents: DataFrame) -> DataFrame:
    """(doc_id, title, document_type, confidence, effective_date, language, words, sections, flags): one record per document row.

    Null and empty texts have an unknown type, no date and no words. Other columns are ignored.
    """
    t = F.col("text")
    d = documents.select("doc_id", t).withColumn("_s", section_headings(t)).withColumn("_c", classify(t, F.array_join("_s", " ")))
    words = F.when(F.trim(t) == "", 0).otherwise(F.size(F.regexp_extract_all(t, F.lit(r"(\S+)"), F.lit(1))))
    return d.select(
        "doc_id", title(t, F.col("_s"), F.lit(None).cast("string")).alias("title"), F.col("_c.type").alias("document_type"), F.col("_c.confidence").alias("confidence"), effective_date(t).alias("effective_date"),
        language(t).alias("language"), F.coalesce(words, F.lit(0)).cast("long").alias("words"), F.size("_s").cast("long").alias("sections"), F.coalesce(F.array_join(personal_flags(t), ","), F.lit("")).alias("flags"),
    )


# Characters a page needs, share of unreadable characters allowed, share of empty pages allowed, weights of the checks, least score.
CHARS_PER_PAGE, GARBLED_SHARE, EMPTY_SHARE, LEAST_QUALITY = 24, 0.02, 0.34, 0.6
WEIGHTS = {"yield": 3.0, "empty": 2.0, "garbled": 3.0, "metadata": 1.0}


def quality(text: Column, record: dict[str, Column], pages: Column, empty_pages: Column) -> Column:
    """struct(verdict, score): weighted checks of yield, empty pages, unreadable characters and metadata.

    ``fail`` if the yield or the readability check fails or the score is below the least, ``warn`` if another check fails,
    else ``pass``. Null and empty texts fail.
    """
    chars, n = F.length(F.coalesce(text, F.lit(""))), F.greatest(F.coalesce(pages, F.lit(1)), F.lit(1))
    per_page, bad, empty = chars / n, F.coalesce(garbled(text), F.lit(0)) / F.greatest(chars, F.lit(1)), F.coalesce(empty_pages, F.lit(0)) / n
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in record.values()])
    scores = {"yield": F.least(F.lit(1.0), per_page / (CHARS_PER_PAGE * 10)), "empty": F.greatest(F.lit(0.0), 1 - empty), "garbled": F.greatest(F.lit(0.0), 1 - bad / GARBLED_SHARE), "metadata": present / len(record)}
    score = reduce(lambda a, b: a + b, [scores[k] * w for k, w in WEIGHTS.items()]) / sum(WEIGHTS.values())
    fails = (per_page < CHARS_PER_PAGE) | (bad > GARBLED_SHARE) | (score < LEAST_QUALITY)
    return F.struct(F.when(fails, "fail").when(empty > EMPTY_SHARE, "warn").otherwise("pass").alias("verdict"), F.round(score, 4).alias("score"))
