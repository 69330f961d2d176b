from datetime import datetime, timedelta

import pytest

from corvane.streaming.exactly_once import deduplicate_stream

MAP = "message_type string, id_source string, message_type_note string"
MSG = "delivery_id long, received_at timestamp, raw string, message_type string, facility string"


def message(kind, control, facility="F", order="X1", marks="|^~\\&"):
    s, c = marks[0], marks[1]
    head = s.join(["MSH", marks[1:], "A", facility, "B", "C", "2026", "", f"{kind}{c}A01", control, "P", "2.4"])
    return head + "\r" + s.join(["OBR", "1", order, f" {order}{c}EXT "]) + "\r" + s.join(["OBR", "2", "", "other"])


@pytest.fixture
def mapping(spark):
    return spark.createDataFrame([("ADT", "MSH-10", ""), ("ORU", "OBR-3.1", ""), ("ADT", "MSH-10", "again")], MAP)


def run(spark, tmp_path, batches, mapping, **kw):
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, MSG).coalesce(1).write.mode("append").parquet(path)
    out = deduplicate_stream(spark, path, mapping, **kw).collect()
    return {r.delivery_id for r in out if r.kind == "surplus"}, {r.delivery_id for r in out if r.kind == "first"}


def test_one_copy_of_each(spark, tmp_path, mapping):
    t = datetime(2026, 1, 1)
    rows = [
        (1, t, message("ADT", "c1"), None, "x"), (2, t + timedelta(days=1), message("ADT", "c1"), None, None), (3, t - timedelta(days=300), message("ADT", "c1", marks="#@`\\$"), None, None),
        (4, t, message("ADT", "c1", facility="G"), None, None), (5, t, message("ORU", "c1"), None, None), (6, t, message("ORU", "zzz"), None, None), (7, t, "no header", None, None), (8, t, message("ADT", " "), None, None),
        (9, t, message("SIU", "c1"), None, None), (10, t, None, None, None), (11, None, message("ADT", "c9"), None, None), (12, t, message("ADT", "c9"), None, None), (13, t, "", None, None), (14, t, "\x0b" + message("ADT", "c1") + "\x1c\r", None, None),
    ]
    surplus, first = run(spark, tmp_path, [rows], mapping)
    assert surplus == {1, 2, 14, 6, 12} and first == {3, 4, 5, 11}


@pytest.mark.parametrize("horizon", [1, 10**9])
def test_late_and_hot_identifiers_over_batches(spark, tmp_path, mapping, horizon):
    t = datetime(2026, 1, 1)
    batches = [
        [(100 + i, t + timedelta(hours=i), message("ADT", "hot"), None, None) for i in range(60)],
        [(200 + i, t + timedelta(days=100 + i), message("ADT", f"k{i % 7}"), None, None) for i in range(21)],
        [(50, t - timedelta(days=5), message("ADT", "hot"), None, None), (60, t - timedelta(days=9), message("ADT", "k3"), None, None), (61, t + timedelta(days=500), message("ADT", "hot"), None, None)],
    ]
    surplus, first = run(spark, tmp_path, batches, mapping, horizon=horizon, files_per_trigger=1)
    assert 50 in first and 60 in first and 100 in surplus and 203 in surplus and 61 in surplus
    assert len(first) == 8 and len(surplus) == 60 + 21 + 3 - 8 and not first & surplus


def test_restart_takes_up_new_files_only(spark, tmp_path, mapping):
    t = datetime(2026, 1, 1)
    kw = {"out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "cp")}
    assert run(spark, tmp_path, [[(1, t, message("ADT", "a"), None, None)]], mapping, **kw) == (set(), {1})
    assert run(spark, tmp_path, [[(2, t, message("ADT", "a"), None, None), (3, t, message("ADT", "b"), None, None)]], mapping, **kw) == ({2}, {1, 3})


def test_identifiers_replace_columns_of_the_same_name(spark, mapping):
    from corvane.operators.messages import identify

    rows = spark.createDataFrame([(1, None, message("ADT", "c1"), "old", "old"), (2, None, "x", None, None)], MSG)
    got = {r.delivery_id: (r.message_type, r.facility, r.identifier) for r in identify(rows, mapping).collect()}
    assert got == {1: ("ADT", "F", "c1"), 2: (None, None, None)}


def test_idle_identifiers_leave_the_state(spark, tmp_path, mapping):
    t = datetime(2026, 1, 1)
    batches = [[(10 * n + i, t + timedelta(days=n), message("ADT", f"day{n}-{i}"), None, None) for i in range(10)] for n in range(6)]
    batches.append([(99, t, message("ADT", "day0-3"), None, None), (98, t + timedelta(days=6), message("ADT", "day1-1"), None, None)])  # after their identifiers expired
    kw = {"out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "cp"), "horizon": 86_400, "files_per_trigger": 1}
    surplus, first = run(spark, tmp_path, batches, mapping, **kw)
    assert surplus == {99, 98} and len(first) == 60
    state = spark.read.format("statestore").load(str(tmp_path / "cp/passed"))
    assert 0 < state.count() <= 30  # of 60 identifiers


def test_repeated_rows_of_a_delivery(spark, tmp_path, mapping):
    t = datetime(2026, 1, 1)
    row = (1, t, message("ADT", "a"), None, None)
    assert run(spark, tmp_path, [[row, row], [row, (2, t, message("ADT", "a"), None, None)]], mapping) == ({2}, {1})
