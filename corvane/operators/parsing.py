"""Rows that fail to parse, separated with a reason while the valid rows are loaded.

Each Arrow batch of raw lines becomes one byte buffer. Structural indexing marks quotes, derives from
their prefix parity which bytes stand inside quotes, and so locates delimiters, fields and record ends
for all lines at once; the checks of counts and types work on that index.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The accepted states, sexes and record kinds of the two line formats.
CSV_COLUMNS = ("observation_id", "patient_ref", "code", "value", "unit", "observed_on", "status", "note")
STATUSES = frozenset(("final", "amended", "preliminary", "entered-in-error", "cancelled"))
GENDERS = frozenset(("male", "female", "other", "unknown"))
KINDS = frozenset(("Observation", "Patient"))

_CODE = re.compile(rb"[0-9]+-[0-9]")
_DECIMAL = re.compile(rb"[+-]?[0-9]+(?:\.[0-9]+)?")
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", re.A)
_QUOTE, _COMMA, _NEWLINE = 0x22, 0x2C, 0x0A


def real_date(text: object) -> bool:
    """Whether ``text`` is an existing date written yyyy-mm-dd."""
    if not isinstance(text, str) or not _DATE.fullmatch(text):
        return False
    try:
        dt.date.fromisoformat(text)
    except ValueError:
        return False
    return True


class StructuralIndex:
    """Delimiters and quoting faults of many delimited lines, found together."""

    def __init__(self, lines: list[bytes], delimiter: int = _COMMA):
        sizes = np.fromiter((len(x) for x in lines), np.int64, len(lines))
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1] if len(lines) else np.zeros(0, np.int64)
        self.ends = self.starts + sizes
        self.buffer = b"\n".join(lines) + b"\n"
        data = np.frombuffer(self.buffer, np.uint8)
        line_of = np.repeat(np.arange(len(lines)), sizes + 1)
        quote = data == _QUOTE
        counted = np.cumsum(quote)  # quotes up to and with this byte
        before = counted - quote
        line_base = before[self.starts][line_of] if len(lines) else before
        inside = (before - line_base) & 1  # parity of the line's quotes before this byte
        is_end = np.zeros(len(data), bool)
        is_end[self.ends] = True  # record ends; a newline within a line is data
        separator = (data == delimiter) & (inside == 0) & ~is_end
        self.field_ends = np.flatnonzero(separator | is_end)
        self.counts = np.bincount(line_of[self.field_ends], minlength=len(lines))
        self.first_field = np.concatenate(([0], np.cumsum(self.counts)))[:-1]
        # a quote that opens stands at a field's beginning or doubles the one before it
        at = np.flatnonzero(quote)
        prev, after = data[np.maximum(at - 1, 0)], data[np.minimum(at + 1, len(data) - 1)]
        at_start = np.isin(at, self.starts) | ((prev == delimiter) & ((inside[np.maximum(at - 1, 0)]) == 0))
        opens = inside[at] == 0
        bad_open = opens & ~at_start & ~((prev == _QUOTE) & (at > 0))
        at_end = np.isin(at + 1, self.ends) | (after == delimiter)
        bad_close = ~opens & ~at_end & (after != _QUOTE)
        self.bad_quoting = np.zeros(len(lines), bool)
        self.bad_quoting[line_of[at[bad_open | bad_close]]] = True
        self.bad_quoting |= (np.bincount(line_of[at], minlength=len(lines)) & 1).astype(bool)

    def fields(self, line: int) -> list[bytes]:
        """The raw fields of one line."""
        k, out, begin = self.first_field[line], [], self.starts[line]
        for end in self.field_ends[k : k + self.counts[line]]:
            out.append(self.buffer[begin:end])
            begin = end + 1
        return out


def _unquote(field: bytes) -> bytes:
    return field[1:-1].replace(b'""', b'"') if field[:1] == b'"' else field


def csv_reasons(lines: list[str]) -> tuple[list[str | None], list[list[str] | None]]:
    """For each line the reason of its rejection or None, and the fields of the valid ones."""
    index = StructuralIndex([x.encode("utf-8", "surrogatepass") for x in lines])
    reasons, values = [], []
    for i in range(len(lines)):
        reason, fields = None, None
        if index.bad_quoting[i]:
            reason = "quoting"
        elif index.counts[i] != len(CSV_COLUMNS):
            reason = "column_count"
        else:
            fields = [_unquote(f) for f in index.fields(i)]
            ok = (
                fields[0].strip() and fields[1].strip() and _CODE.fullmatch(fields[2]) and (not fields[3] or _DECIMAL.fullmatch(fields[3]))
                and real_date(fields[5].decode("utf-8", "replace")) and fields[6].decode("utf-8", "replace") in STATUSES
            )
            if not ok:
                reason, fields = "invalid_value", None
        reasons.append(reason)
        values.append([f.decode("utf-8", "replace") for f in fields] if fields else None)
    return reasons, values


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _missing(value: object) -> bool:
    return value is None or value == "" or value == [] or value == {}


def ndjson_reason(line: str) -> str | None:
    """The reason why a line isn't a valid resource, or None."""
    try:
        record = json.loads(line, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return "bad_json"
    if not isinstance(record, dict):
        return "bad_json"
    kind = record.get("resourceType")
    if _missing(kind) or _missing(record.get("id")) or (kind == "Observation" and _missing(record.get("status"))):
        return "missing_field"
    if not isinstance(kind, str) or kind not in KINDS:
        return "invalid_value"
    if kind == "Patient":
        gender = record.get("gender")
        return None if real_date(record.get("birthDate")) and isinstance(gender, str) and gender in GENDERS else "invalid_value"
    status, quantity = record["status"], record.get("valueQuantity")
    if not isinstance(status, str) or status not in STATUSES or not real_date(record.get("effectiveDateTime")):
        return "invalid_value"
    if quantity is not None:
        if not isinstance(quantity, dict):
            return "invalid_value"
        if "value" in quantity and (isinstance(quantity["value"], bool) or not isinstance(quantity["value"], (int, float))):
            return "invalid_value"
    return None


def load_import_lines(lines: DataFrame, keep: str = "all") -> DataFrame:
    """(import_id, line_number, line_format, line, reason, fields): each non-blank line with the reason of its rejection.

    ``reason`` is null for a valid line; ``fields`` has the eight csv values of a valid csv line. ``keep`` is
    ``all``, ``rejects`` or ``valid``. Null and blank lines are skipped, an unknown or null format is rejected as
    ``unknown_format``; further columns are ignored; repeated lines stay repeated.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["line"].notna()]
            text = pdf["line"].str.removesuffix("\r")
            pdf = pdf.assign(_text=text)[text.str.strip() != ""].reset_index(drop=True)
            reason, fields = pd.Series([None] * len(pdf), dtype=object), pd.Series([None] * len(pdf), dtype=object)
            kind = pdf["line_format"]
            if len(rows := np.flatnonzero(kind == "csv")):
                r, f = csv_reasons(pdf["_text"].iloc[rows].tolist())
                for k, a, b in zip(rows, r, f):
                    reason[k], fields[k] = a, b
            for k in np.flatnonzero(kind == "ndjson"):
                reason[k] = ndjson_reason(pdf["_text"].iat[k])
            reason[~kind.isin(["csv", "ndjson"])] = "unknown_format"
            out = pdf.drop(columns="_text").assign(reason=reason, fields=fields)
            yield out if keep == "all" else out[reason.notna() if keep == "rejects" else reason.isna()]

    cols = lines.select("import_id", F.col("line_number").cast("long").alias("line_number"), "line_format", "line")
    return cols.mapInPandas(parse, "import_id string, line_number long, line_format string, line string, reason string, fields array<string>")


_FRAMING = "\x0b\x1c\r\n"
_LINE_END = re.compile(r"\r\n|\r|\n")


def header_of(text: str) -> tuple[str, str] | None:
    """(field separator, encoding characters) that a message declares, or None."""
    head = _LINE_END.split(text, maxsplit=1)[0].rstrip("\x1c\x0b")
    if len(head) < 8 or head[:3] != "MSH":
        return None
    separator, encoding = head[3], head[4:8]
    marks = separator + encoding[:3]
    if any(x.isalnum() or x.isspace() for x in marks) or len(set(marks)) < 4:
        return None
    return separator, encoding


def bad_segments(raws: list[str | None]) -> list[list[int] | None]:
    """Per message None if it has no header, else the numbers of its lines that are no segments.

    The lines of all messages of a batch are indexed in one buffer: record ends are found by masks, and
    the three bytes before the first field separator are classified together.
    """
    out: list[list[int] | None] = []
    pieces, owner, separators = [], [], []
    for k, raw in enumerate(raws):
        text = (raw or "").lstrip(_FRAMING)
        head = header_of(text)
        out.append(None if head is None else [])
        if head:
            pieces.append(text.encode("utf-32-le", "surrogatepass"))
            owner.append(k)
            separators.append(ord(head[0]))
    if not pieces:
        return out
    sizes = np.array([len(p) // 4 + 1 for p in pieces])
    data = np.frombuffer(b"\n\0\0\0".join(pieces) + b"\n\0\0\0", np.uint32)
    message = np.repeat(np.arange(len(pieces)), sizes)
    ends = np.flatnonzero((data == 10) | (data == 13))
    begins = np.concatenate(([0], ends[:-1] + 1))
    space = np.isin(data, np.array([9, 11, 12, 28, 32, 133, 160], np.uint32)) | (data == 10) | (data == 13)
    visible = np.concatenate(([0], np.cumsum(~space)))
    keep = visible[ends] > visible[begins]  # non-blank lines
    ends, begins = ends[keep], begins[keep]
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    framing = np.isin(data, np.array([11, 28], np.uint32))
    # framing bytes around a segment don't count
    begins = begins + framing[begins]
    pad = np.zeros(4, bool)
    up, word, values = np.concatenate((upper, pad)), np.concatenate((upper | digit, pad)), np.concatenate((data, np.zeros(4, np.uint32)))
    own = message[begins]
    after = values[begins + 3]
    closes = (after == np.array(separators, np.uint32)[own]) | (begins + 3 == ends) | ((after == 28) & (begins + 4 >= ends))
    good = up[begins] & word[begins + 1] & word[begins + 2] & (begins + 3 <= ends) & closes
    first = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1)) if len(own) else np.zeros(0, int)
    base = np.zeros(len(own), int)
    base[first] = first
    number = np.arange(len(own)) - np.maximum.accumulate(base) + 1
    for m, n in zip(own[~good], number[~good]):
        out[owner[m]].append(int(n))
    return out


def unreadable_segments(messages: DataFrame) -> DataFrame:
    """(delivery_id, line_number, reason) of messages without header (line 0, ``no_header``) and of lines that are no segments (``bad_segment``).

    A null or empty message has no header. Lines are counted from 1 over the non-blank ones.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, bad in zip(pdf["delivery_id"], bad_segments([x if isinstance(x, str) else None for x in pdf["raw"]])):
                rows += [(key, 0, "no_header")] if bad is None else [(key, n, "bad_segment") for n in bad]
            yield pd.DataFrame(rows, columns=["delivery_id", "line_number", "reason"])

    return messages.select("delivery_id", "raw").mapInPandas(parse, "delivery_id long, line_number long, reason string")


def unreadable(lines: DataFrame, messages: DataFrame) -> DataFrame:
    """(source_name, record_id, line_number, reason), distinct, over import lines and messages."""
    a = load_import_lines(lines, "rejects").select(F.lit("bulk_import_line").alias("source_name"), F.col("import_id").alias("record_id"), "line_number", "reason")
    b = unreadable_segments(messages).select(F.lit("hl7_message").alias("source_name"), F.col("delivery_id").cast("string").alias("record_id"), "line_number", "reason")
    return a.unionByName(b).distinct()
