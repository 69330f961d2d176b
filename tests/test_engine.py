"""Metrics, disclosure, loads and the operators on small inputs with known results."""

import json
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import deidentify, similarity, text
from corvane.operators import graph, retrieval, series
from corvane.operators.disclosure import suppress
from corvane.operators.linkage import pair_scores
from corvane.plans.metrics import CATALOGUE, Metric, dim_date, measure, run_metric
from corvane.plans.schema import CLINICAL, Col, Fact, Schema
from corvane.sources.files import IncrementalLoader, export_with_manifest, upsert_dimension, write_report
from corvane.sources.messages import decode, parse, parse_message, results, validate
from corvane.streaming import events as ev

OBS = "observation_key string, patient_key string, cohort_key string, code_key string, organization_key string, value double, unit string, is_abnormal boolean, status string, organization_id string, date_key int, load_id string"


def observations(spark, n_a=30, n_b=5):
    rows = [(f"o{i}", f"p{i}", "c", "k", "g", float(i), "u", i % 3 == 0, "final", "org:a" if i < n_a else "org:b", 20260301, "l") for i in range(n_a + n_b)]
    return spark.createDataFrame(rows, OBS)


def dims(spark, fact):
    return {"dim_date": dim_date(fact), "dim_code": spark.createDataFrame([("k", "1", "L", "Glucose", "lab")], "code_key string, code string, code_system string, display string, category string"), "dim_cohort": spark.createDataFrame([("c", "0-4", "male", "021", None)], "cohort_key string, age_band string, sex string, postal_prefix string, risk_band string"), "dim_organization": spark.createDataFrame([], "organization_key string, organization_id string, organization_name string, organization_kind string, region string")}


def test_catalogue_is_valid(spark):
    assert len(CATALOGUE) == 18
    for m in CATALOGUE.values():
        m.validate()
    with pytest.raises(ValueError):
        CATALOGUE["abnormal_result_rate"].check_grouping(("dim_cohort.sex",))
    with pytest.raises(ValueError):
        CLINICAL.resolve(CLINICAL.facts["fact_observation"], "patient_key")
    with pytest.raises(ValueError):
        Col("x", "KEY")
    with pytest.raises(ValueError):
        Schema({"f": Fact("f", (), {"a": "dim"})}, {})
    with pytest.raises(ValueError):
        Metric("m", "fact_observation", "sum", "unit", subject="patient_key").validate()


def test_metric_is_scoped_and_unknown_dimension(spark):
    fact = observations(spark)
    m = CATALOGUE["abnormal_result_rate"]
    a = run_metric(m, fact, dims(spark, fact), "org:a").collect()
    assert [(r.dim_code__display, r.value, r.subjects, r.suppressed) for r in a] == [("Glucose", pytest.approx(10 / 30, abs=1e-6), 30, False)]
    b = run_metric(m, fact, dims(spark, fact), "org:b").collect()
    assert b[0].value is None and b[0].reason == "small_cell"
    assert run_metric(m, fact, dims(spark, fact), "org:a", date_from=20260401, date_to=20260402).count() == 0
    by_org = run_metric(m, fact, dims(spark, fact), group_by=("dim_organization.organization_name",), every_organization=True).collect()
    assert by_org[0].dim_organization__organization_name == "unknown"
    with pytest.raises(ValueError):
        run_metric(m, fact, dims(spark, fact), " ")
    with pytest.raises(ValueError):
        run_metric(m, fact, dims(spark, fact), "org:a", date_from=2, date_to=1)


def test_floor_percentile(spark):
    df = spark.createDataFrame([(float(i), "a", 1) for i in range(1, 11)] + [(None, "a", 1), (7.0, "b", 1), (None, "c", 1)], "x double, g string, date_key int")
    m = Metric("p", "fact_job_run", "percentile", "x")
    assert {r.g: r.value for r in measure(df, m, ["g"]).collect()} == {"a": 9.0, "b": 7.0}
    assert measure(df, m, []).collect()[0].value == 9.0


def loop(cells, total, minimum, additive):
    """Complementary suppression cell by cell."""
    hidden = {g for g, v, s in cells if 0 < s < minimum}
    if not additive or not hidden:
        return hidden
    while len(hidden) == 1 or total - sum(v for g, v, _ in cells if g not in hidden) <= 0:
        rest = sorted((v, g) for g, v, _ in cells if g not in hidden)
        if not rest:
            break
        hidden.add(rest[0][1])
    return hidden


def test_disclosure_equals_loop(spark):
    rng = random.Random(1)
    for case in range(12):
        cells = [(f"g{i}", float(v := rng.choice([0, 0, 1, 3, 12, 40, 41])), v) for i in range(rng.randrange(1, 7))]
        total = sum(v for _, v, _ in cells) + rng.choice([0, 0, 5])
        df = spark.createDataFrame(cells, "g string, value double, subjects long")
        t = spark.createDataFrame([(float(total),)], "total double")
        for additive in (True, False):
            got = {r.g for r in suppress(df, t, ["g"], 11, additive).collect() if r.suppressed}
            assert got == loop(cells, total, 11, additive), (case, cells, total)


def test_text_functions(spark):
    rows = [(1, "Blood-\npressure  was 12.5 mg/dL\r\n\r\n\r\n\r\nof   the"), (2, None), (3, ""), (4, "x" * 50_000), (5, "A\x0cA\x0cB")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in df.select("doc_id", text.normalise(F.col("text")).alias("n"), text.terms(F.col("text")).alias("t"), text.token_estimate(F.col("text")).alias("e"), text.language(F.col("text")).alias("l"), text.garbled(F.col("text")).alias("g")).collect()}
    assert got[1].n == "Bloodpressure was 12.5 mg/dL\n\nof the" and got[1].t == ["blood", "pressure", "12.5", "mg/dl"]
    assert got[2].n is None and got[3].e == 0 and got[4].e == 12500 and got[1].l is None and got[5].g == 2
    assert {(r.doc_id, r.class_id, r.copies) for r in text.exact_copies(spark.createDataFrame([(1, "A  b"), (2, "a B"), (3, "c"), (4, None)], "doc_id long, text string")).collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1)}
    assert [r.line for r in text.furniture(spark.createDataFrame([(1, "Head\na\x0cHead\nb\x0cHead\nc"), (2, "Head\x0cHead")], "doc_id long, text string")).collect()] == ["Head"]
    assert text.headings(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcde", max_size=9), st.text(alphabet="abcde", max_size=9))
def test_jaro_winkler_bounds(a, b):
    v = similarity.jaro_winkler_value(a, b)
    assert 0 <= v <= 1 and (v == 1) == (a == b)
    assert similarity.jaro_winkler_value("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)


def test_pair_scores(spark):
    rows = [(1, "a", 1.0, 5.0, ""), (1, "b", 0.0, -2.0, "h"), (1, "c", 1.0, 6.0, "h"), (1, "d", None, 9.0, ""), (1, "a", 1.0, 5.0, ""), (2, "a", None, 1.0, None)]
    got = {r.pair_id: (r.score, r.score_zone) for r in pair_scores(spark.createDataFrame(rows, "pair_id long, field_name string, similarity double, weight double, correlation_group string")).collect()}
    assert got == {1: (11.0, "review"), 2: (0.0, "non_match")}


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "iron iron anaemia"), (2, "gout"), (3, None), (4, ""), (5, "iron")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "the iron"), (8, "zzz"), (9, None)], "query_id long, query_text string")
    assert [(r.query_id, r.doc_id, r["rank"]) for r in retrieval.bm25(docs, q).orderBy("rank").collect()] == [(7, 5, 1), (7, 1, 2)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "doc_id long, embedding array<float>")
    got = retrieval.vector_top_k(v, v.withColumnRenamed("doc_id", "query_id"), k=2, block=1)
    assert {(r.query_id, r.doc_id, r.score) for r in got.where("rank = 1").collect()} == {(1, 1, 1.0), (2, 2, 1.0), (3, 1, 0.5)}
    fused = retrieval.fuse({"a": spark.createDataFrame([(1, 5, 1)], "query_id long, doc_id long, rank int"), "b": spark.createDataFrame([(1, 5, None)], "query_id long, doc_id long, rank int")}).collect()
    assert fused[0].fused == pytest.approx(1 / 61, abs=1e-9)
    packed = retrieval.pack_context(spark.createDataFrame([(1, "a", "w " * 40, 1), (1, "b", "v " * 30, 2), (1, "c", "u " * 9, 3), (1, "d", "U  " * 9, 4)], "query_id long, id string, text string, rank int"), budget=50)
    assert [r.id for r in packed.orderBy("rank").collect()] == ["a", "c"]
    m = retrieval.rank_metrics(spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, doc_id long, rank int"), spark.createDataFrame([(1, 2, 1), (1, 3, 1), (2, 1, 1)], "query_id long, doc_id long, gain int"), k=2)
    got = {r.query_id: r for r in m.collect()}
    assert got[1].precision == 0.5 and got[1].recall == 0.5 and got[1].reciprocal_rank == 0.5 and got[1].average_precision == 0.25 and got[2].ndcg == 0


def test_packing_reads_all_candidates(spark):
    rng = random.Random(6)
    # the hot query has more candidates than an Arrow batch; its small texts stand at the end
    rows = [(1, f"h{i:05}", f"t{i} " + "w " * (900 if i < 23_000 else 40), i) for i in range(23_050)]
    rows += [(q, f"{q}-{i}", f"t{i} " + "v " * rng.randrange(1, 1500), rng.choice([i, i, 7, None])) for q in (None, 0, 2**60, 2**60 + 1) for i in range(700)]
    want = set()
    for query in {r[0] for r in rows}:
        rest, placed = 5000, 0
        for q, i, t, rank in sorted((r for r in rows if r[0] == query), key=lambda r: (r[3] is None, r[3] or 0, r[1])):
            n = len(t.split()) + -(-len(t.split()[0]) // 4) - 1
            if placed < 20 and n <= rest:
                rest, placed = rest - n, placed + 1
                want.add((q, i, rank, n))
    packed = retrieval.pack_context(spark.createDataFrame(rows, "query_id long, id string, text string, rank int")).collect()
    assert len(packed) == len(want) and {tuple(r) for r in packed} == want and max(r.id for r in packed if r.query_id == 1) > "h23000"
    assert retrieval.pack_context(spark.createDataFrame([], "query_id long, id string, text string, rank int")).count() == 0


def test_graph_first_path_wins(spark):
    e = spark.createDataFrame([("a", "b", 2, 0.5), ("a", "c", 1, 1.0), ("b", "d", 3, 1.0), ("c", "d", 4, 0.1)], "start string, end string, seq long, confidence double")
    got = {r.node: (r.hop, r.confidence) for r in graph.traverse(e, spark.createDataFrame([("a",)], "node string"), 2, decay=1.0).collect()}
    assert got == {"a": (0, 1.0), "b": (1, 0.5), "c": (1, 1.0), "d": (2, 0.5)}


def test_series(spark):
    f = spark.createDataFrame([(1, 10, 1.0, 1), (1, 10, 2.0, 2), (1, 20, None, 3), (None, 5, 9.0, 4), (1, None, 8.0, 5)], "k long, at long, v double, seq long")
    p = spark.createDataFrame([(1, 9), (1, 10), (1, 25), (2, 10)], "k long, t long")
    assert {(r.k, r.t): r.feature for r in series.as_of(p, f, "k", "t", "at", "v", "seq").collect()} == {(1, 9): None, (1, 10): 2.0, (1, 25): None, (2, 10): None}
    assert [r.seq for r in series.latest(f.where("k = 1"), ["k"], "at", "seq").collect()] == [3]
    t = spark.createDataFrame([(1, 1, 100.0), (1, 2, 104.0), (2, 1, 1.0), (2, 2, 2.0), (3, 1, 1.0)], "k long, at long, v double")
    assert {r.k: r.trend for r in series.trend(t, ["k"], "at", "v").collect()} == {1: "stable", 2: "rising", 3: "unknown"}
    b = spark.createDataFrame([(None, False), (None, True), (True, True)], "a boolean, b boolean")
    assert [r.x for r in b.select(series.truth(series.all_known(F.col("a"), F.col("b"))).alias("x")).collect()] == ["false", "unknown", "true"]


def test_deidentify(spark):
    r = spark.createDataFrame([(93, "036-01", "x"), (None, None, None), (0, "0213 4", "y"), (-1, "abc", "z")], "age int, z string, v string").select(deidentify.age_band(F.col("age")).alias("a"), deidentify.cohort_prefix(F.col("z")).alias("z"), deidentify.pseudonym(F.col("v"), "s", "p").alias("v")).collect()
    assert [(x.a, x.z) for x in r] == [("90+", "suppressed"), ("unknown", "unknown"), ("0-4", "021"), ("unknown", "unknown")] and r[1].v is None and r[0].v.startswith("p_")
    with pytest.raises(ValueError):
        deidentify.pseudonym(F.lit("x"), "")


def test_incremental_loads_are_idempotent(spark, tmp_path):
    loader = IncrementalLoader(spark, str(tmp_path / "fact"), ["k"])
    one = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k long, v string")
    assert loader.load(one, 1, "v") == {"received": 4, "rejected": 1, "duplicates": 1, "loaded": 2}
    assert loader.load(one, 1, "v")["loaded"] == 2
    assert loader.load(one, 2, "v") == {"received": 4, "rejected": 1, "duplicates": 3, "loaded": 0}
    assert sorted(r.v for r in loader.committed().collect()) == ["a", "d"]
    d = upsert_dimension(one.withColumn("o", F.lit(1)), spark.createDataFrame([(1, "z", 0)], "k long, v string, o int"), "k", "o")
    assert {r.k: r.v for r in d.collect()} == {1: "z", 2: "d"}
    assert export_with_manifest({"t": one}, str(tmp_path / "out")) == {"t": 4}
    assert json.loads(sorted(r.value for r in spark.read.text(str(tmp_path / "out" / "t")).collect())[0]) == {"k": 1, "v": "a"}
    write_report(spark.createDataFrame([("g", 3.0, True)], "g string, value double, suppressed boolean"), str(tmp_path / "csv"))
    assert "3.0" not in "".join(r.value for r in spark.read.text(str(tmp_path / "csv")).collect())


def test_messages(spark):
    raw = "\x0bMSH|^~\\&|A|B|||2026||ORU^R01|c1\rPID|1||77^^^X~88||Doe\\T\\Co^Jo||\rOBR|1\rOBX|1|NM|718-7^Hb||7.1|g\\S\\L|||||F\rzz|\r\x1c\r"
    segments, bad = parse_message(raw)
    assert [s["name"] for s in segments] == ["MSH", "PID", "OBR", "OBX"] and bad == ["zz|"]
    assert segments[1]["fields"][2] == [["77", "", "", "X"], ["88"]] and segments[1]["fields"][4][0][0] == "Doe&Co" and segments[3]["fields"][5][0] == ["g^L"]
    assert decode("a\\X41\\\\.br\\\\H\\b\\Q\\", "|", "^~\\&") == "aA\nb\\Q\\" and parse_message(None) == (None, [])
    raws = spark.createDataFrame([(1, raw), (2, None), (3, "MSH|^~\\&|A|B|||2026||ADT^A01|c\rPID|1")], "delivery_id long, raw string")
    m = parse(raws)
    assert {r.delivery_id: (r.acknowledgement, r.missing) for r in validate(m).collect()} == {1: ("AA", ""), 2: ("AR", None), 3: ("AE", "EVN")}
    assert [(r.code, r.value, r.status) for r in results(raws).collect()] == [("718-7", "7.1", "F")] and results(raws).collect()[0].unit == "g^L"


def test_events(spark, tmp_path):
    e = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 5), (4, "a", 5), (5, "b", 9), (6, "a", None)], "id long, k string, s long")
    assert {(r.id, r.violation) for r in ev.order_violations(e, ["k"], "s", "id").collect()} == {(3, "gap"), (4, "regression")}
    assert ev.partition_offsets(e, "k", 4, "id").where("offset = 0").count() <= 2
    path = str(tmp_path / "ev")
    spark.createDataFrame(pd.DataFrame({"id": [1, 1, 2], "at": pd.to_datetime(["2026-01-01 00:00", "2026-01-01 00:01", "2026-01-01 00:07"]), "v": [1.0, 2.0, 3.0]})).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    q = ev.first_delivery(stream, "id", "at", "1 hour").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2
    q = ev.sliding_rates(stream, "at", "v", "10 minutes", "5 minutes", "1 minute").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.window_start), r.events) for r in spark.table("rates").collect()} == {("2025-12-31 23:55:00", 2), ("2026-01-01 00:00:00", 3), ("2026-01-01 00:05:00", 1)}
