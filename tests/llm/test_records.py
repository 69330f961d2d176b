"""Linkage and mixing."""

import datetime as dt
import math
import pathlib
import random
import time

import numpy as np
import pandas as pd

from corvane.llm import linkage, mixing

PERSON = "record_id string, source_system string, names array<struct<use_code: string, family: string, given: array<string>>>, birth_date date, sex string, addresses array<struct<line: string, city: string, postal_code: string>>, telecom array<struct<system: string, value: string>>, received_at timestamp, given string, rid string"


def person(i, source, family, given, born, phone, street, postal, at=1):
    return (i, source, [("official", family, given.split() if given else None)], born, "female", [(street, "T", postal)] if street or postal else [], [("phone", phone)] if phone else [], dt.datetime(2026, 1, at), "clash", "clash")


def population(n=220, seed=4):
    rng = random.Random(seed)
    given = "Ada Hugo Irene Martin Zoe Emil Karim Luca Clara Oskar Petra Jonas Maud Felix".split()
    family = [a + b for a in ("Alder", "Bram", "Cald", "Fen", "Lark", "Nor", "Quill", "Tarn", "Wex") for b in ("by", "more", "holt", "wick", "gard", "low", "vane")]
    rows, truth = [], set()
    for k in range(n):
        f, g, born = rng.choice(family), rng.choice(given), dt.date(1930, 1, 1) + dt.timedelta(days=rng.randrange(32000))
        phone, street, postal = f"{rng.randrange(200, 999)}55501{rng.randrange(10, 99)}", f"{rng.randrange(400)} Quarry Road", f"{rng.randrange(10000, 99999)}"
        a, b, relative = f"a{k:03}", f"b{k:03}", f"c{k:03}"
        rows.append(person(a, "one", f, g, born, phone, street, postal))
        kind = k % 6
        rows.append(person(b, "two", f.upper() if kind == 0 else f + "x" if kind == 1 else f, g, None if kind == 2 else born.replace(day=born.day % 28 + 1) if kind == 3 else born, None if kind == 4 else phone, None if kind == 5 else street.replace("Road", "Rd."), postal + "-1111"))
        truth.add((a, b))
        rows.append(person(relative, "three", f, rng.choice([x for x in given if x != g]), born + dt.timedelta(days=9000), phone, street, postal))
    return rows, truth


def test_matches_of_a_population(spark):
    rows, truth = population()
    rows += [person("a000", "one", "Older", "Name", None, None, None, None, at=1)[:7] + (dt.datetime(2025, 1, 1), "", "")]
    got = {(r.record_id_a, r.record_id_b): r.confidence for r in linkage.match_records(spark.createDataFrame(rows, PERSON)).collect()}
    found = set(got)
    assert len(found & truth) / len(truth) > 0.95 and len(found & truth) / len(found) > 0.95
    assert all(0.5 <= c <= 1 for c in got.values())


def test_hot_block_keeps_links(spark):
    """A third of all records share one telephone number; another third are equal copies."""
    rows, truth = population(120)
    rows = [r[:6] + ([("phone", "5555555555")],) + r[7:] if i % 3 else r for i, r in enumerate(rows)]
    copies = [person(f"x{i:03}", ("one", "two")[i % 2], "Same", "Ada", dt.date(1990, 1, 1), "2005550100", "1 A St", "11111") for i in range(40)]
    got = {(r.record_id_a, r.record_id_b) for r in linkage.match_records(spark.createDataFrame(rows + copies, PERSON)).collect()}
    assert len({p for p in got if p[0][0] == "x"}) == 20 * 20
    assert len(got & truth) / len(truth) > 0.9


PEOPLE = "rid long, parts array<string>, givens array<string>, birth date, contacts array<string>, places array<string>, postals array<string>"


def test_chunked_block_pairs_are_complete(spark):
    ids = list(range(130))
    people = spark.createDataFrame([(i, ["same"], ["n"], dt.date(1990, 1, 1), ["5550001111"], [], []) for i in ids], PEOPLE)
    pairs = {(r.a, r.b) for r in linkage.candidate_pairs(people, chunk=30).collect()}
    assert pairs == {(a, b) for a in ids for b in ids if a < b}


def test_large_block_keeps_pairs_of_different_records(spark):
    """Records that share their telephone number and nothing else, and pairs that share no other block either."""
    ids = list(range(130))
    rows = [(i, [f"{chr(97 + i % 26) * 4}{i}"], [f"{chr(97 + i // 26) * 3}{i}"], dt.date(1930, 1, 1) + dt.timedelta(days=190 * i), ["5550001111"], [f"{i} st|{10000 + i}"], [f"{10000 + i}"]) for i in ids]
    people = spark.createDataFrame(rows, PEOPLE)
    for chunk in (30, 500):
        pairs = [(r.a, r.b) for r in linkage.candidate_pairs(people, chunk=chunk).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in ids for b in ids if a < b}


def test_hot_name_keeps_changed_records(spark):
    """Many records of one name and birth year; a match with a wrong day and other contacts meets only in those blocks."""
    rows = []
    for k in range(80):
        born = dt.date(1970, 1 + k % 12, 1 + k % 27)
        rows.append((2 * k, ["alderby"], ["ada"], born, [f"2005550{k:03}"], [f"{k} a st|{10000 + k}"], [f"{10000 + k}"]))
        rows.append((2 * k + 1, ["alderby"], ["ada"], born.replace(day=born.day + 1), [f"3005551{k:03}"], [f"{k} b st|{20000 + k}"], [f"{20000 + k}"]))
    people = spark.createDataFrame(rows, PEOPLE)
    pairs = {(r.a, r.b) for r in linkage.candidate_pairs(people, chunk=5).collect()}
    assert {(2 * k, 2 * k + 1) for k in range(80)} <= pairs


def test_equal_records_are_scored(spark):
    """Equal records with a name and a telephone number are one person, those with nothing but a name aren't compared."""
    rows, _ = population()
    for source in ("one", "two"):
        rows += [person(f"p-{source}", source, "Alderby", "Ada", None, "2015550999", None, None), person(f"n-{source}", source, "Larkwick", "Hugo", None, None, None, None)]
        rows += [person(f"full-{source}", source, "Tarnvane", "Zoe", dt.date(1980, 5, 5), "2015550888", "7 Elm Road", "55555")]
    got = {(r.record_id_a, r.record_id_b): r.confidence for r in linkage.match_records(spark.createDataFrame(rows, PERSON)).collect()}
    assert 0.5 <= got["p-one", "p-two"] <= 1 and got["full-one", "full-two"] == 1 and ("n-one", "n-two") not in got


def test_disk_is_freed_and_slices_dont_matter(spark):
    """Shuffle files and blocks are deleted as soon as their result is written; any number of slices gives the same matches."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    tables = lambda: list(pathlib.Path(spark.conf.get("spark.checkpoint.dir")[7:]).glob("corvane/*/*"))
    size = lambda: sum(f.apply(i).length() for f in [files()] for i in range(f.size()))
    rows, _ = population()
    rows += [(f"z{k}", *rows[k][1:]) for k in range(30)]  # equal records
    spark._jvm.System.gc()
    time.sleep(2)
    before, known = size(), set(tables())
    whole = linkage.match_records(spark.createDataFrame(rows, PERSON))
    assert size() - before < 20_000 and not [t for t in set(tables()) - known if t.name.startswith(("blocks", "cells", "met"))]
    sliced = linkage.match_records(spark.createDataFrame(rows, PERSON), pairs_per_class=8, least_pairs=1)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sliced.collect()))


def test_nulls_and_empty(spark):
    rows = [("a", None, None, None, None, None, None, None, None, None), (None, "one", [("official", "X", ["Y"])], None, None, None, None, None, None, None), ("b", "two", [], None, None, [], [], None, None, None), ("c", "two", [(None, None, None)], None, "", [(None, None, None)], [(None, None)], None, None, None)]
    assert linkage.match_records(spark.createDataFrame(rows, PERSON)).count() == 0
    assert linkage.match_records(spark.createDataFrame([], PERSON)).count() == 0


def test_calibration_on_held_out_pairs():
    rng = np.random.default_rng(2)
    n = 4000
    y = rng.random(n) < 0.4
    level = lambda p, q, top: np.where(rng.random(n) < np.where(y, p, q), top, 0)
    s = pd.DataFrame({"given_l": level(0.95, 0.1, 3), "family_l": level(0.97, 0.4, 3), "middle_l": -1, "birth_l": level(0.9, 0.02, 3), "sex_l": level(0.99, 0.5, 1), "phone_l": level(0.7, 0.2, 1), "street_l": level(0.7, 0.2, 1), "postal_l": level(0.8, 0.25, 1), "swapped": 0})
    s["n"], s["fold"] = 1, np.arange(n) % 5
    m = linkage.PairModel(s[:3000])
    x = np.column_stack((linkage._matrix(s[3000:]), np.ones(1000)))
    p = 1 / (1 + np.exp(-((x @ m.weights) * m.scale + m.shift)))
    assert np.mean((p > 0.5) == y[3000:]) > 0.93 and abs(p.mean() - y[3000:].mean()) < 0.08


TEXT = "The patient reported chest tightness for three days before coming to the ward. "


def test_mixture_reaches_targets(spark):
    rng = random.Random(8)
    rows = [(i, TEXT * rng.randrange(1, 6), rng.choice(["en", "en", "de", None]), rng.choices(["big", "mid", "tiny"], [80, 18, 2])[0], rng.choice(["x", "y", None]), "clash", 1) for i in range(1500)]
    rows += [(9001, None, "en", "big", "x", "", 1), (9002, "", "en", "big", "x", "", 1), (9003, TEXT, "en", None, "x", "", 1), (9004, TEXT, "en", "untargeted", "x", "", 1), (None, TEXT, "en", "big", "x", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, document_type string, tokens string, copies long")
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.4, 3), ("tiny", 0.1, 4), ("absent", 0.0, 2)], "source string, target_share double, max_repeats long")
    mixture, report = mixing.mix(docs, targets)
    r = {x.source: x for x in report.collect()}
    for s, share in (("big", 0.5), ("mid", 0.4), ("tiny", 0.1)):
        assert abs(r[s].reached_share - share) < 0.01 and r[s].largest_copies <= r[s].max_repeats
    assert r["tiny"].mixed_tokens == 4 * r["tiny"].available_tokens or max(x.mixed_tokens / (x.max_repeats * x.available_tokens) for x in r.values()) > 0.98
    ids = [x.doc_id for x in mixture.collect()]
    assert len(ids) == len(set(ids)) and not {9001, 9002, 9003, 9004, None} & set(ids)
    again = mixing.mix(docs.repartition(7), targets)[0]
    assert sorted((x.doc_id, x.copies) for x in again.collect()) == sorted((x.doc_id, x.copies) for x in mixture.collect())
    # a size beyond the caps: sources at their cap fall short and are reported so
    short = {x.source: x for x in mixing.mix(docs, targets, total_tokens=1e7)[1].collect()}
    assert all(x.mixed_tokens <= x.max_repeats * x.available_tokens for x in short.values())
    m, empty = mixing.mix(docs.limit(0), targets)
    assert m.count() == 0 and {x.reached_share for x in empty.collect()} == {0.0}


def test_mixture_reaches_targets_of_languages_and_topics(spark):
    rng = random.Random(9)
    rows = [(i, TEXT * rng.randrange(1, 6), rng.choice(["en", "en", "en", "de", "fr", None]), rng.choices(["big", "mid"], [80, 20])[0], rng.choice(["x", "x", "y", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, document_type string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.5, 3)], "source string, target_share double, max_repeats long")
    languages, topics = {"en": 0.4, "de": 0.5, "unknown": 0.1, "absent": 0.0}, {"x": 3, "y": 5, "unknown": 2}
    for total in (None, 40_000):
        mixture, report = mixing.mix(docs, targets, total_tokens=total, languages=languages, topics=topics)
        got = mixture.toPandas()
        got["mass"] = got["tokens"] * got["copies"]
        assert "fr" not in set(got["lang"]) and (got["copies"] <= got["source"].map({"big": 2, "mid": 3})).all()
        for k, shares in (("lang", languages), ("topic", topics), ("source", {"big": 1, "mid": 1})):
            for v, share in shares.items():
                assert abs(got[got[k] == v]["mass"].sum() / got["mass"].sum() - share / sum(shares.values())) < 0.02
        assert total is None or abs(got["mass"].sum() / total - 1) < 0.02
    only = mixing.mix(docs, targets, languages={"de": 1.0})[0].toPandas()
    assert set(only["lang"]) == {"de"} and set(only["topic"]) == {"x", "y", "unknown"}
    assert mixing.mix(docs, targets, languages={"absent": 1.0})[0].count() == 0


def test_raking_meets_marginals():
    cells = pd.DataFrame([(s, la, t, 1000 + 37 * i) for i, (s, la, t) in enumerate((s, la, t) for s in "ab" for la in ("en", "de") for t in "xyz")], columns=["source", "lang", "topic", "tokens"])
    marginals = {"lang": {"en": 0.7, "de": 0.3}, "topic": {"x": 0.5, "y": 0.25, "z": 0.25}, "source": {"a": 0.8, "b": 0.2}}
    copies = mixing.rake(cells, marginals, 20_000, {"a": 50.0, "b": 50.0})
    mass = copies * cells["tokens"]
    for k, shares in marginals.items():
        for v, share in shares.items():
            assert math.isclose(mass[cells[k] == v].sum() / mass.sum(), share, rel_tol=1e-3)


def test_all_names_addresses_and_contacts_count(spark):
    """A nickname, a second telephone number, an e-mail address or a second address connects records as the first ones do."""
    rows, _ = population()
    born = dt.date(1981, 2, 3)
    base = person("m-one", "one", "Quillmar Orsby Tann", "Theodora", born, "2015550111", "1 Elm Road", "44444")
    other = person("m-two", "two", "Tann", "Dory", born, "2015550222", "2 Oak Lane", "33333")
    names = [("official", "Tann", ["Dory"]), ("nickname", None, ["Theodora"])]
    contacts = [("phone", "2015550222"), ("email", "T.Tann@example.org"), ("phone", "201-555-0111")]
    changed = list(other)
    for k, v in enumerate(changed):
        if isinstance(v, list) and v and v[0][0] == "phone":
            changed[k] = contacts
        elif isinstance(v, list) and v and len(v[0]) == 3 and v[0][1] == "Tann":
            changed[k] = names
    got = {(r.record_id_a, r.record_id_b) for r in linkage.match_records(spark.createDataFrame([*rows, base, tuple(changed)], PERSON)).collect()}
    assert ("m-one", "m-two") in got
