"""Header fields and identifiers of delimiter-declaring messages, read in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_text(raw: Column) -> Column:
    """The text after leading framing bytes and line ends."""
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"^[\x0B\x1C\r\n]+", "")


def header_line(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"^[^\r\n]*", 0), r"[\x0B\x1C]+$", "")


def declares_header(head: Column) -> Column:
    """Whether a first line is an MSH segment of at least eight characters with four distinct marks."""
    marks = [F.substring(head, k, 1) for k in range(4, 8)]
    distinct = F.size(F.array_distinct(F.array(*marks))) == 4
    return (F.length(head) >= 8) & head.startswith("MSH") & distinct & ~F.substring(head, 4, 4).rlike(r"[\p{L}\p{N}\s]")


def identify(messages: DataFrame, mapping: DataFrame) -> DataFrame:
    """``messages`` with message_type, facility and identifier; the mapping names the identifier's field per type.

    ``mapping`` needs message_type and id_source such as ``OBR-3.1`` or ``MSH-10``. Messages without header, of
    an unmapped type or with an empty identifier get a null identifier. The first occurrence of the field counts:
    its first segment and repetition, by default its first component. Columns of the same names are replaced.
    """
    own = [c for c in messages.columns if c not in ("message_type", "facility", "identifier")]
    spec = mapping.where(F.col("id_source").isNotNull()).select(
        F.col("message_type").alias("_type"),
        F.regexp_extract("id_source", r"^([A-Z][A-Z0-9]{2})-(\d+)(?:\.(\d+))?$", 1).alias("_segment"),
        F.regexp_extract("id_source", r"^([A-Z][A-Z0-9]{2})-(\d+)(?:\.(\d+))?$", 2).try_cast("int").alias("_field"),
        F.coalesce(F.regexp_extract("id_source", r"^([A-Z][A-Z0-9]{2})-(\d+)(?:\.(\d+))?$", 3).try_cast("int"), F.lit(1)).alias("_component"),
    ).dropDuplicates(["_type"])  # one row per message type, as the mapping has it
    m = messages.withColumn("_text", clean_text(F.col("raw"))).withColumn("_head", header_line(F.col("_text")))
    ok = declares_header(F.col("_head"))
    sep, comp, rep = (F.substring("_head", k, 1) for k in (4, 5, 6))
    m = m.withColumns({"_ok": ok, "_sep": F.when(ok, sep), "_comp": F.when(ok, comp), "_rep": F.when(ok, rep)})
    part = F.split_part
    m = m.withColumn("message_type", F.when(F.col("_ok"), F.trim(part(part(F.col("_head"), F.col("_sep"), F.lit(9)), F.col("_comp"), F.lit(1)))))
    m = m.withColumn("facility", F.when(F.col("_ok"), F.trim(part(F.col("_head"), F.col("_sep"), F.lit(4)))))
    m = m.join(spec, F.col("message_type") == F.col("_type"), "left")
    lines = F.split(F.col("_text"), r"[\r\n]+")
    # FHS and BHS number their fields like MSH: the separator itself is the first
    line = F.when(F.col("_segment") == "MSH", F.col("_head")).otherwise(
        F.get(F.filter(lines, lambda x: F.regexp_replace(x, r"^[\x0B\x1C]+", "").startswith(F.concat(F.col("_segment"), F.col("_sep")))), F.lit(0))
    )
    at = F.when(F.col("_segment") == "MSH", F.col("_field")).otherwise(F.col("_field") + 1)
    value = part(part(part(F.regexp_replace(line, r"[\x0B\x1C]+$", ""), F.col("_sep"), at), F.col("_rep"), F.lit(1)), F.col("_comp"), F.col("_component"))
    return m.withColumn("identifier", F.nullif(F.trim(value), F.lit(""))).select(*own, "message_type", "facility", "identifier")
