import csv
import io
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.operators.parsing import STATUSES, StructuralIndex, bad_segments, csv_reasons, load_import_lines, ndjson_reason, real_date, unreadable

LINES = "import_id string, line_format string, line_number long, line string, reason string"


def slow_quoting(line):
    """Field by field: bare without quotes, or wholly quoted with inner quotes doubled."""
    i, fields = 0, []
    while True:
        if line[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"' and line[j + 1 : j + 2] == '"':
                    text, j = text + '"', j + 2
                elif line[j] == '"':
                    break
                else:
                    text, j = text + line[j], j + 1
            i = j + 1
            fields.append(text)
        else:
            j = line.find(",", i)
            part = line[i:] if j < 0 else line[i:j]
            if '"' in part:
                return None
            fields.append(part)
            i += len(part)
        if i >= len(line):
            return fields
        if line[i] != ",":
            return None
        i += 1
        if i == len(line):
            return [*fields, ""]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='ab,"é ', min_size=1, max_size=14), min_size=1, max_size=6))
def test_structural_index_equals_field_by_field(lines):
    index = StructuralIndex([x.encode() for x in lines])
    for i, line in enumerate(lines):
        fields = slow_quoting(line)
        assert bool(index.bad_quoting[i]) == (fields is None), line
        if fields is not None:
            assert index.counts[i] == len(fields), line
            assert index.fields(i) == [f.encode() for f in _raw(line)]


def _raw(line):
    out, quoted, part = [], False, ""
    for ch in line:
        quoted ^= ch == '"'
        if ch == "," and not quoted:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def test_csv_reasons():
    ok = 'o1,P1,2345-7,12.5,mmol/L,2026-02-28,final,"said ""fine"", ok"'
    cases = {ok: None, ok + ",x": "column_count", "o1,P1": "column_count", ok.replace('""fine""', '"fine"'): "quoting", ok[:-1]: "quoting", ok.replace("02-28", "02-30"): "invalid_value",
             ok.replace("12.5", ""): None, ok.replace("12.5", "1e3"): "invalid_value", ok.replace("P1", " "): "invalid_value", ok.replace("final", "Final"): "invalid_value", ok.replace("2345-7", "2345-77"): "invalid_value", ok.replace("12.5", '"12.5"'): None}
    got, values = csv_reasons(list(cases))
    assert got == list(cases.values())
    assert values[0] == next(csv.reader(io.StringIO(ok)))


def test_ndjson_reasons():
    good = '{"resourceType":"Observation","id":"a","status":"final","effectiveDateTime":"2026-01-31","valueQuantity":{"value":1.5}}'
    cases = {good: None, good[:-1]: "bad_json", good + good: "bad_json", "[" + good + "]": "bad_json", good.replace('"id":"a"', '"id":""'): "missing_field", good.replace('"status":"final",', ""): "missing_field",
             good.replace("final", "done"): "invalid_value", good.replace("1.5", '"1.5"'): "invalid_value", good.replace("1.5", "true"): "invalid_value", good.replace("1.5", "NaN"): "bad_json", good.replace("Observation", "OBX"): "invalid_value",
             '{"resourceType":"Patient","id":"p","gender":"female","birthDate":"1990-01-01"}': None, '{"resourceType":"Patient","id":"p","gender":"F","birthDate":"1990-01-01"}': "invalid_value", "[" * 100_000: "bad_json"}
    for line, reason in cases.items():
        assert ndjson_reason(line) == reason, line[:80]
    assert not real_date("2026-2-01") and not real_date(None) and real_date("2024-02-29") and "final" in STATUSES


def slow_segments(raw):
    text = raw.lstrip("\x0b\x1c\r\n")
    head = re.split(r"[\r\n]", text, maxsplit=1)[0].rstrip("\x1c\x0b")
    if len(head) < 8 or not re.match(r"MSH([^\w\s])(?!\1)([^\w\s])(?!\1|\2)([^\w\s])(?!\1|\2|\3)([^\w\s]).*", head):
        return None
    out, n = [], 0
    for line in re.split(r"\r\n|\r|\n", text):
        line = line.strip("\x0b\x1c")
        if line.strip():
            n += 1
            if not re.fullmatch(r"[A-Z][A-Z0-9]{2}", line.split(text[3])[0]):
                out.append(n)
    return out


def test_segments_equal_line_by_line():
    from pandas import read_parquet

    raws = read_parquet("/root/testdata/sf0.01/hl7_message.parquet").raw.tolist()
    raws += ["", None, "\x0b\x1c\r", "MSH|^~\\&|A\r\rPID", "MSH|^~\\&|A\r \r9BX|1", "MSH|||||||||", "MSHX^~\\&|A", "MSH|^~\\&|A\rPID|é|" + "x" * 100_000]
    got = bad_segments(raws)
    for raw, g in zip(raws, got):
        assert g == (slow_segments(raw) if raw else None), repr(raw)[:80]


def test_unreadable_and_loading(spark):
    rows = [("i", "csv", 1, "", None), ("i", "csv", 2, " \r", None), ("i", "csv", 3, "a,b", "clash"), ("i", "csv", 3, "a,b", "clash"), ("i", "ndjson", 4, "{}", None), (None, "csv", 5, "x", None), ("i", None, 6, "x", None), ("i", "csv", None, "x", None), ("i", "csv", 7, None, None)]
    lines = spark.createDataFrame(rows, LINES)
    messages = spark.createDataFrame([(1, None, "x"), (2, "MSH|^~\\&|A\rzz|1\r\rPID|1", "y")], "delivery_id long, raw string, reason string")
    got = {tuple(r) for r in unreadable(lines, messages).collect()}
    assert ("bulk_import_line", "i", 3, "column_count") in got and ("bulk_import_line", "i", 4, "missing_field") in got and ("bulk_import_line", "i", 6, "unknown_format") in got
    assert ("hl7_message", "1", 0, "no_header") in got and ("hl7_message", "2", 2, "bad_segment") in got and len(got) == 7
    assert load_import_lines(lines, "valid").count() == 0 and load_import_lines(lines.limit(0)).count() == 0
    good = spark.createDataFrame([("i", "csv", 1, "o1,P1,2345-7,,u,2026-01-01,final,\r", None)], LINES)
    assert load_import_lines(good).collect()[0].fields == ["o1", "P1", "2345-7", "", "u", "2026-01-01", "final", ""]
