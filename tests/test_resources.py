import pytest
from pyspark.sql import functions as F

from corvane.functions.chunking import MOST, chunk, sentences, tokens_of
from corvane.operators import evidence as E
from corvane.operators import resources as R

LINES = [
    '{"resourceType":"Patient","id":"p1","gender":"female","name":[{"family":"Doe"}],"birthDate":"1990-01-01"}',
    '{"resourceType":"Observation","id":"o1","status":"final","subject":{"reference":"Patient/p1"},"code":{"coding":[{"code":"718-7"}]},"effectiveDateTime":"2026-01-02"}',
    '{"resourceType":"Observation","id":"o2","status":"cancelled","subject":{"reference":"Patient/p1"}}', '{"resourceType":"Observation","id":""}', "[1]", "no json", "", None, '{"id":5,"resourceType":"X"}',
]


def test_search_and_compartments(spark):
    r = R.read_resources(spark.createDataFrame([(x,) for x in LINES + LINES[:1]], "line string"))
    assert sorted(x.id for x in r.collect()) == ["5", "o1", "o2", "p1"]
    assert [x.id for x in R.search(r, "Observation").collect()] == ["o1"] and [x.id for x in R.search(r, "Observation", with_retracted=True, subject="Patient/p1").collect()] == ["o1", "o2"]
    assert R.search(r, "Observation", code="718-7", date="2026-01").count() == 1 and R.search(r, "Patient", family="do").count() == 1 and R.search(r, "Patient", offset=1).count() == 0
    with pytest.raises(ValueError):
        R.search(r, "Patient", shoe="9")
    assert {(x.subject, x.resource_type): x.resources for x in R.compartments(r).collect()} == {("Patient/p1", "Patient"): 1, ("Patient/p1", "Observation"): 2}


def test_versions(spark):
    schema = "resource_type string, id string, version int, deleted boolean, resource string"
    log = spark.createDataFrame([("P", "a", 1, False, "x"), ("P", "a", 2, None, "y"), ("P", "b", 1, False, "z"), ("P", "b", 2, True, None)], schema)
    assert [(r.id, r.resource) for r in R.current(log).collect()] == [("a", "y")]
    ch = [("P", "a", "create", None, "n", 1), ("P", "b", "create", None, "n", 1), ("P", "c", "update", None, "n", 1), ("P", "a", "update", 1, "n", 2), ("P", "d", "create", None, "n", 1), ("P", "d", "delete", None, None, 2), ("P", "e", "delete", None, None, 1)]
    new, refused = R.apply_changes(log, spark.createDataFrame(ch, "resource_type string, id string, action string, expected_version int, resource string, sequence int"))
    assert {(r.id, r.version, r.deleted) for r in new.collect()} == {("b", 3, False), ("d", 1, False)}
    assert {(r.id, r.sequence, r.reason) for r in refused.collect()} == {("a", 1, "exists"), ("a", 2, "repeated"), ("c", 1, "missing"), ("d", 2, "repeated"), ("e", 1, "missing")}


def test_chunks(spark):
    assert sentences("Seen by Dr. Doe at 2.5 mg. It settled! Fine.") == ["Seen by Dr. Doe at 2.5 mg.", "It settled!", "Fine."]
    text = "Intro.\nFINDINGS\n" + "The wound was clean and dry. " * 200 + "\nPLAN\nRest."
    d = spark.createDataFrame([(1, text), (2, None), (3, " \n"), (4, "x" * 20_000)], "doc_id long, text string")
    got = chunk(d).collect()
    one = [c for c in got if c.doc_id == 1]
    assert {c.heading for c in one} == {"", "FINDINGS", "PLAN"} and all(c.tokens <= MOST and c.tokens == tokens_of(c.chunk) for c in one)
    assert not [c for c in got if c.doc_id in (2, 3)] and [c.tokens for c in got if c.doc_id == 4] == [5000]
    assert sum(c.chunk.count("wound") for c in one) >= 200


def test_evidence(spark):
    d = spark.createDataFrame([(1, "A  b"), (2, "a B"), (3, "c"), (4, None)], "id long, t string")
    assert sorted(r.id for r in E.deduplicate(d, "t", [F.col("id")]).collect()) == [1, 3, 4]
    c = spark.createDataFrame([(1, "x", "sodium 140 and 7"), (1, "y", "140"), (1, "x", "7"), (2, "x", None)], "g long, k string, t string")
    assert [(r.g, r.number) for r in E.corroborated(c, "g", "k", "t").collect()] == [(1, "140")]
    v = spark.createDataFrame([("iron is low", "the iron value"), ("", "x"), (None, "x")], "a string, b string").select(E.coverage(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in v] == [0.5, None, None]
    o = spark.createDataFrame([("a", 1, 9), ("a", 2, 1), ("b", 5, 3)], "partition string, sequence long, due_at long")
    assert [(r.partition, r.sequence) for r in E.claim_heads(o, F.lit(5), 9).collect()] == [("b", 5)]
