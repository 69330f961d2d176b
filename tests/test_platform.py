import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane.functions import documents as D
from corvane.functions import mapping
from corvane.operators import disclosure, graph, loads, population, retrieval
from corvane.plans.facade import Dashboard, Parameter, QueryRefused, Registry, Template, default_registry, is_due
from corvane.plans.metrics import CATALOGUE, Metric, run_metric
from corvane.streaming import events as ev
from corvane.streaming import log

FACT = "observation_key string, patient_key string, cohort_key string, code_key string, organization_key string, value double, unit string, is_abnormal boolean, status string, organization_id string, date_key int, load_id string"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(f"o{i}", f"p{i % 40}", "c1", "k1" if i % 3 else "gone", "g1", float(i), "mg", i % 2 == 0, "final", "org:1" if i % 4 else "org:2", 20260100 + 1 + i % 28, "l") for i in range(200)]
    rows.append(("x", None, None, None, None, None, None, None, None, "org:1", None, "l"))
    return spark.createDataFrame(rows, FACT)


@pytest.fixture(scope="module")
def dims(spark):
    return {"dim_code": spark.createDataFrame([("k1", "1", "s", "Glucose", "lab")], "code_key string, code string, code_system string, display string, category string"),
            "dim_cohort": spark.createDataFrame([("c1", "40-44", "female", "036", None)], "cohort_key string, age_band string, sex string, postal_prefix string, risk_band string"),
            "dim_organization": spark.createDataFrame([("g1", "org:1", "One", "x", None)], "organization_key string, organization_id string, organization_name string, organization_kind string, region string")}


def test_a_metric_needs_its_organisation(facts, dims):
    m = CATALOGUE["abnormal_result_rate"]
    for missing in (None, " "):
        with pytest.raises(ValueError):
            run_metric(m, facts, dims, missing)
    one, every = (run_metric(m, facts, dims, *a, **k) for a, k in ((("org:2",), {}), ((), {"every_organization": True})))
    assert sum(r.subjects for r in one.collect()) < sum(r.subjects for r in every.collect())
    with pytest.raises(ValueError):
        run_metric(m, facts, dims, "org:1", max_scan_rows=10)
    assert run_metric(m, facts.limit(0), dims, "org:1").count() == 0


def test_totals_are_withheld(spark):
    cells = spark.createDataFrame([("a", 4.0, 4), ("b", 20.0, 20), ("c", 30.0, 30)], "g string, value double, subjects long")
    got = {r.g: (r.value, r.reason, r.total, r.total_withheld) for r in disclosure.suppress(cells, None, ["g"], 11, True, with_total=True).collect()}
    assert got == {"a": (None, "small_cell", 54.0, False), "b": (None, "complementary", 54.0, False), "c": (30.0, None, 54.0, False)}
    alone = cells.where("g = 'a'")
    assert [(r.total, r.total_withheld) for r in disclosure.suppress(alone, None, ["g"], 11, True, with_total=True).collect()] == [(None, True)]
    with pytest.raises(PySparkException):
        disclosure.suppress(alone, None, ["g"], 11, True, with_total=True, may_withhold=False).collect()
    assert disclosure.suppress(cells.limit(0), None, ["g"], 11, True, with_total=True).count() == 0


def test_templates(facts, dims):
    registry = default_registry()
    assert len(registry.templates) == 18
    ask = lambda **k: registry.ask("abnormal_result_rate", facts, dims, "org:1", {"analyst"}, **k)
    assert {r.dim_code__display for r in ask(parameters={"from": "2026-01-01", "to": "2026-01-31"}).collect()} == {"Glucose", "unknown"}
    for bad in ({"from": "x"}, {"when": "2026-01-01"}, {"from": "2026-02-01", "to": "2026-01-01"}, {"from": "2024-01-01", "to": "2026-01-01"}):
        with pytest.raises(QueryRefused):
            ask(parameters=bad)
    with pytest.raises(QueryRefused):
        ask(group_by=("dim_cohort.sex",))
    for args in (("abnormal_result_rate", facts, dims, " ", {"analyst"}), ("abnormal_result_rate", facts, dims, "org:1", set()), ("none", facts, dims, "org:1", {"analyst"})):
        with pytest.raises(QueryRefused):
            registry.ask(*args)
    with pytest.raises(QueryRefused):
        registry.add(Template("second", "abnormal_result_rate"))
    with pytest.raises(QueryRefused):
        Registry().add(Template("wide", "abnormal_result_rate", group_by=("dim_cohort.sex",)))
    board = Dashboard("b", (("abnormal_result_rate", "dim_code.display"), ("cohort_patient_count", "dim_cohort.age_band")))
    assert {r.tile for r in board.render(registry, {"fact_observation": facts}, dims, "org:1", {"analyst"}).collect()} == {"abnormal_result_rate", "cohort_patient_count"}


def test_parameters_and_schedules():
    assert Parameter("n", "integer", least=1, most=5).read("3") == 3 and Parameter("d", "date").read("2026-02-03") == dt.date(2026, 2, 3)
    for p, v in ((Parameter("n", "integer", most=5), 9), (Parameter("n", "integer"), "x"), (Parameter("x", "decimal"), "nan"), (Parameter("c", "choice", allowed=("a",)), "b")):
        with pytest.raises(QueryRefused):
            p.read(v)
    d = dt.date
    assert is_due("daily", None, d(2026, 1, 1)) and not is_due("daily", d(2026, 1, 1), d(2026, 1, 1)) and is_due("weekly", d(2026, 1, 4), d(2026, 1, 5))
    assert not is_due("monthly", d(2026, 1, 1), d(2026, 1, 31)) and is_due("monthly", d(2026, 1, 31), d(2026, 3, 1))
    with pytest.raises(ValueError):
        Metric("m", "fact_nothing", "count").validate()


def test_message_times_and_mapping(spark):
    values = ["2026", "202603", "20260320", "202603201430", "20260320143007.123-0500", "x", "", None]
    t = spark.createDataFrame([(v, "i") for v in values], "v string, k string")
    got = [tuple(r) for r in t.select(mapping.message_time(F.col("v")), mapping.message_time(F.col("v"), timezone="Z"), mapping.message_time(F.col("v"), "date")).collect()]
    assert got[0] == ("2026",) * 3 and got[1] == ("2026-03",) * 3 and got[2] == ("2026-03-20",) * 3
    assert got[3] == (None, "2026-03-20T14:30:00Z", "2026-03-20") and got[4] == ("2026-03-20T14:30:07-05:00",) * 2 + ("2026-03-20",)
    assert all(g == (None,) * 3 for g in got[5:])
    m = mapping.map_fields(t, {"t": ("v", "instant", {}), "s": ("v", "sex", {})}, ["k"]).collect()
    assert [r.unmapped for r in m] == [[], [], [], ["t"], [], ["t"], [], []] and all(r.s == "unknown" for r in m)
    with pytest.raises(ValueError):
        mapping.map_fields(t, {"t": ("v", "shout", {})}, [])


def test_documents(spark):
    rows = [
        (1, "Printed 2020-01-01\nDate of service: 2024-05-06\nexamination date 2023-01-01\nFINDINGS\nMRI radiology report technique"), (2, "seen 3/9/2021 and 2/30/2022"), (3, "On March 5, 2022 the abstract"), (4, None), (5, ""), (6, "born 1850-01-01"),
        (7, "Collected: June 7, 2021; reported 01/02/2020"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, document_type string")
    got = {r.doc_id: r for r in D.metadata(docs).collect()}
    assert [got[i].effective_date for i in range(1, 8)] == [dt.date(2024, 5, 6), dt.date(2021, 3, 9), dt.date(2022, 3, 5), None, None, None, dt.date(2021, 6, 7)]
    assert got[1].document_type == "radiology_report" and got[1].title == "Printed 2020-01-01" and got[4].document_type == "unknown" and got[5].words == 0
    q = docs.select("doc_id", D.quality(F.col("text"), {"d": F.col("document_type")}, F.lit(1), F.lit(1)).alias("q")).collect()
    assert {r.doc_id: r.q.verdict for r in q}[4] == "fail"
    page = "HEAD\nbody {}\nmore\nlast {}\n"
    paged = spark.createDataFrame([("a", "\x0c".join(page.format(i, i) for i in range(4))), ("b", None)], "doc_id string, text string")
    clean = {r.doc_id: r for r in D.without_furniture(paged).collect()}
    assert "HEAD" not in clean["a"].text and "body 2" in clean["a"].text and clean["a"].removed_lines >= 3 and clean["b"].text is None


def test_ranges_equal_one_window(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(400) if i % 11 else None) for i in range(800)]
    e = spark.createDataFrame(rows, "at long, k string, seq long").repartition(5)
    tops, expected = {}, set()
    for at, k, seq in rows:
        if seq is None:
            continue
        if k in tops and seq != tops[k] + 1:
            expected.add((at, "gap" if seq > tops[k] + 1 else "regression"))
        tops[k] = max(tops.get(k, seq), seq)
    assert {(r.at, r.violation) for r in ev.order_violations(e, ["k"], "seq", "at").collect()} == expected
    got = ev.partition_offsets(e, "k", 3, "at").collect()
    for p in range(3):
        mine = sorted((r.at, r.offset) for r in got if r.partition == p)
        assert [o for _, o in mine] == list(range(len(mine)))
    assert len(got) == 800 and ev.partition_offsets(e.limit(0), "k", 3, "at").count() == 0


def test_chains(spark):
    rows = [(k % 3, k, f"p{k}") for k in range(60)]
    chain = ev.chained(spark.createDataFrame(rows, "tenant long, seq long, payload string"), "tenant", "seq")
    assert ev.verify_chain(chain, "tenant", "seq").count() == 0
    broken = chain.where("seq <> 30").withColumn("payload", F.when(F.col("seq") == 7, "other").otherwise(F.col("payload")))
    assert {r.seq for r in ev.verify_chain(broken, "tenant", "seq").collect()} == {7, 33}


def test_log_groups(spark):
    rows = spark.createDataFrame([(p, o, f"k{o % 2}") for p in range(2) for o in range(10)], "partition int, offset long, key string")
    held = spark.createDataFrame([("g", 0, 4)], "group string, partition int, offset long")
    assert {(r.group, r.partition): r.lag for r in log.lag(rows, held, ["g", "h"]).collect()} == {("g", 0): 6, ("g", 1): 10, ("h", 0): 10, ("h", 1): 10}
    assert [r.offset for r in log.replay(rows, partition=1, key="k1", start=3).collect()] == [3, 5, 7, 9]
    with pytest.raises(ValueError):
        log.replay(rows, start=1, base=2)
    back = spark.createDataFrame([("g", 0, 2), ("g", 1, 3)], "group string, partition int, offset long")
    assert {(r.partition, r.offset, r.regressed) for r in log.commit(held, back).collect()} == {(0, 4, True), (1, 3, False)}
    assert {(r.partition, r.offset) for r in log.poll(rows, held, "g", 2).collect()} == {(0, 4), (0, 5), (1, 0), (1, 1)}


def test_populations_and_loads(spark):
    rows = spark.createDataFrame([("a", 1, dt.date(2026, 1, 2), 5.0), ("a", 2, dt.date(2026, 1, 1), 7.0), ("b", 1, None, 3.0), (None, 1, dt.date(2026, 1, 1), 1.0), ("c", 3, dt.date(2020, 1, 1), None)], "who string, kind int, day date, v double")
    assert [tuple(r) for r in population.series_summary(rows, ["who"], "day", "v").where("who = 'a'").collect()] == [("a", 7.0, 5.0, 6.0, 5.0, 7.0, 2)]
    assert {r.who for r in population.cohort(rows, "who", F.col("v") > 2, F.col("kind") == 2).collect()} == {"b"}
    assert {r.who: r.recency for r in population.recency(rows, "who", "day", F.lit("2026-06-01").cast("date")).collect()} == {"a": 1.0, "b": 0.5, None: 1.0, "c": 0.0}
    assert {r.who: r.agreement for r in population.agreement(rows, "who", "kind").collect()}["a"] == 0.6667
    line = population.timeline({"x": rows.select("who", F.col("kind").alias("event_id"), "day")}, "who").collect()
    assert {(r.who, r.event_id, r.position) for r in line} == {("a", "2", 1), ("a", "1", 2), ("b", "1", None), ("c", "3", 1)}
    held = spark.createDataFrame([("s", "f", 10), ("t", "f", 5)], "source string, fact string, cursor long")
    runs = spark.createDataFrame([("s", "f", 7, "succeeded"), ("t", "f", 9, "failed"), ("u", "f", 3, "partial")], "source string, fact string, cursor long, status string")
    assert {(r.source, r.cursor, r.refused) for r in loads.advance(held, runs).collect()} == {("s", 10, True), ("t", 5, False), ("u", 3, False)}
    assert {(r.source, r.cursor) for r in loads.advance(held, runs, reset=True).collect()} == {("s", 7), ("t", 5), ("u", 3)}


def test_graph_search(spark):
    nodes = spark.createDataFrame([("a", "x", "heart failure of a patient"), ("b", "x", "heart"), ("c", "y", None), ("d", "y", "failure"), ("e", "x", "heart failure")], "node string, label string, text string")
    found = graph.node_matches(nodes, "Heart failure")
    assert [(r.node, r.overlap) for r in found.collect()] == [("a", 2), ("e", 2), ("b", 1), ("d", 1)]
    assert [r.node for r in graph.entry_points(found, per_label=1).collect()] == ["a", "d"]
    old = spark.createDataFrame([("n", {"a": "1", "b": "2"})], "node string, properties map<string,string>")
    new = spark.createDataFrame([("n", {"b": "3"}, 1), ("n", {"b": "4", "c": "5"}, 2), (None, {"x": "y"}, 3)], "node string, properties map<string,string>, seq long")
    assert {r.node: r.properties for r in graph.upsert_nodes(old, new).collect()} == {"n": {"a": "1", "b": "4", "c": "5"}}


def test_embeddings_are_unit_vectors_of_their_words():
    a, b, c, none, null = retrieval.embed_batch(["heart failure and asthma", "asthma and heart failure", "broken wrist", "?", None], 64)
    assert abs(a @ a - 1) < 1e-9 and a @ b > 0.6 > abs(a @ c) and not none.any() and not null.any()
    assert (retrieval.embed_batch(["broken wrist"], 64)[0] == c).all()
