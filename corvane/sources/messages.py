"""Delimited clinical messages: parsing to nested arrays, escapes, paths, acknowledgements."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.messages import clean_text, declares_header, header_line
from ..operators.parsing import bad_segments, header_of

_LINES = re.compile(r"\r\n|\r|\n")
_SEGMENTS = "array<struct<name: string, fields: array<array<array<string>>>>>"

#: Required segments per message type.
REQUIRED = {"ADT": ("EVN", "PID"), "ORU": ("PID", "OBR"), "ORM": ("PID", "ORC"), "SIU": ("SCH",)}


def decode(value: str, separator: str, encoding: str) -> str:
    """Text with its escape sequences decoded: delimiters, hexadecimal bytes and line breaks; formatting is dropped, unknown ones stay."""
    escape = encoding[2:3] or "\\"
    if escape not in value:
        return value
    marks = {"F": separator, "S": encoding[0:1], "R": encoding[1:2], "E": escape, "T": encoding[3:4]}

    def one(m: re.Match) -> str:
        code = m.group(1)
        if code in marks:
            return marks[code]
        if code[:1] == "X" and re.fullmatch(r"(?:[0-9A-Fa-f]{2})+", code[1:]):
            return bytes.fromhex(code[1:]).decode("latin-1")
        if code == ".br":
            return "\n"
        return "" if code[:1] == "." or code in ("H", "N") else m.group()

    e = re.escape(escape)
    return re.sub(f"{e}([^{e}]*){e}", one, value)


def parse_message(raw: str | None) -> tuple[list[dict] | None, list[str]]:
    """(segments or None without a header, lines that are no segments). Fields count from 1; the separator is MSH-1."""
    text = (raw or "").lstrip("\x0b\x1c\r\n")
    head = header_of(text)
    if head is None:
        return None, []
    separator, encoding = head
    lines = [x.strip("\x0b\x1c") for x in _LINES.split(text)]
    lines = [x for x in lines if x.strip()]
    bad = set(bad_segments([raw])[0] or ())
    segments = []
    for number, line in enumerate(lines, 1):
        if number in bad:
            continue
        name, *fields = line.split(separator)
        if name == "MSH":
            rest = fields[1:]
            parsed = [[[separator]], [[fields[0] if fields else ""]]]
        else:
            rest, parsed = fields, []
        for f in rest:
            parsed.append([[decode(c, separator, encoding) for c in r.split(encoding[0])] for r in f.split(encoding[1])])
        segments.append({"name": name, "fields": parsed})
    return segments, [lines[n - 1] for n in sorted(bad)]


def parse(messages: DataFrame) -> DataFrame:
    """(delivery_id, segments, unparsed_lines); segments are null without a readable header, unparsed_lines empty if all lines are segments."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [parse_message(x if isinstance(x, str) else None) for x in pdf["raw"]]
            yield pd.DataFrame({"delivery_id": pdf["delivery_id"], "segments": [s for s, _ in out], "unparsed_lines": [b for _, b in out]})

    return messages.select("delivery_id", "raw").mapInPandas(rows, f"delivery_id long, segments {_SEGMENTS}, unparsed_lines array<string>")


def field(segment: str, number: int, component: int = 1, repetition: int = 1):
    """A column with one component of the first segment of a name; null where the message has none."""
    found = F.get(F.filter("segments", lambda s: s["name"] == segment), F.lit(0))
    return F.nullif(F.get(F.get(F.get(found["fields"], F.lit(number - 1)), F.lit(repetition - 1)), F.lit(component - 1)), F.lit(""))


def validate(parsed: DataFrame) -> DataFrame:
    """(delivery_id, message_type, missing, acknowledgement): AR without header, AE with missing required segments, else AA."""
    kind = field("MSH", 9)
    names = F.transform("segments", lambda s: s["name"])
    needed = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    missing = F.array_except(F.coalesce(F.try_element_at(needed, kind), F.array().cast("array<string>")), names)
    return parsed.select(
        "delivery_id", kind.alias("message_type"), F.when(F.col("segments").isNotNull(), F.array_join(missing, ",")).alias("missing"),
        F.when(F.col("segments").isNull(), "AR").when(F.size(missing) > 0, "AE").otherwise("AA").alias("acknowledgement"),
    )


def results(messages: DataFrame) -> DataFrame:
    """(delivery_id, position, code, value, unit, status): one row per result segment of (delivery_id, raw), repeating segments kept apart.

    Works in the JVM on the lines of the result segments alone. Escaped delimiters are decoded; empty fields are null.
    Position counts a message's lines from 0. Messages without header have no rows.
    """
    m = messages.select("delivery_id", clean_text(F.col("raw")).alias("t")).withColumn("h", header_line(F.col("t"))).where(declares_header(F.col("h")))
    m = m.select("delivery_id", *[F.substring("h", k, 1).alias(n) for n, k in (("s", 4), ("c", 5), ("r", 6), ("e", 7))], F.rpad(F.substring("h", 8, 1), 1, "&").alias("b"), F.posexplode(F.filter(F.split("t", r"[\r\n]+"), lambda x: ~x.rlike(r"^[\s\x0B\x1C]*$"))).alias("position", "line"))
    m = m.where(F.col("line").startswith(F.concat(F.lit("OBX"), F.col("s"))))

    def part(n: int) -> Column:
        value = F.split_part(F.split_part(F.split_part(F.regexp_replace("line", r"[\x0B\x1C]+$", ""), F.col("s"), F.lit(n + 1)), F.col("r"), F.lit(1)), F.col("c"), F.lit(1))
        for code, mark in (("F", "s"), ("S", "c"), ("R", "r"), ("T", "b"), ("E", "e")):
            value = F.replace(value, F.concat("e", F.lit(code), "e"), F.col(mark))
        return F.nullif(value, F.lit(""))

    return m.select("delivery_id", "position", part(3).alias("code"), part(5).alias("value"), part(6).alias("unit"), part(11).alias("status"))
