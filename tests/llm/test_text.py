"""Leaks, reading levels, scanned pages and personal data."""

import random

import numpy as np
import pandas as pd
import pytest

from corvane.llm import leakage, ocr, privacy, reading_level

ITEM = "Some hastily admitted tram conductor itches after warm baths shortly after cleaning a pigeon loft. Free carnitine measures 73.3 once haemolysis is excluded, versus 2.6 with a drumming precordium."
DOCS = "doc_id long, text string, item_id string, share string"


def test_search_equals_brute_force():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=14))) for i in range(30)] + [(99, "w1 w2"), (98, "")]
    texts = [" ".join(rng.choices([*words, "other"], k=rng.randrange(0, 60))).split() for _ in range(80)]
    search = leakage.WordSearch(items)
    t, at, p = search.find(texts)
    got = {(int(a), int(b), place) for a, b, c in zip(t, at, p) for place in search.places[c]}
    want = {(i, k, (item, j)) for i, text in enumerate(texts) for k in range(len(text) - 3) for item, it in items for j in range(len(it.split()) - 3) if text[k : k + 4] == it.split()[j : j + 4]}
    assert got == want
    assert [len(x) for x in leakage.WordSearch([]).find(texts)] == [0, 0, 0]


def test_leaks(spark):
    w = ITEM.split()
    half, third = " ".join(w[:16]), " ".join(w[:9])
    changed = " ".join("swapped" if i in (5, 14) else x for i, x in enumerate(w) if i != 20).upper().replace(" ", "\n")
    two = " ".join(w[3:12]) + " some other words that stand in between here " + " ".join(w[18:27])
    backwards = " ".join(w[18:27]) + " some other words that stand in between here " + " ".join(w[3:12])
    rows = [(1, f"a {ITEM} b", "x", "y"), (2, half, None, None), (3, third, None, None), (4, changed, None, None), (5, two, None, None), (6, backwards, None, None), (7, None, None, None), (8, "", None, None), (None, ITEM, None, None),
            (9, "filler words " * 60_000 + ITEM, None, None), (10, " ".join(sorted(w)), None, None), (1, f"a {ITEM} b", "x", "y")]
    items = spark.createDataFrame([(70, ITEM, "z"), (71, None, ""), (72, "too short", ""), (70, ITEM, "z")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame(rows, DOCS)
    for per_pass in (20_000, 1):
        got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items, block_items=per_pass).collect()}
        assert got == {(k, 70) for k in (1, 2, 4, 5, 9)}
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.where("item_id = 71")).count() == 0


LEVELS = {
    "easy": "Take one pill each day. Drink some water. Call us if you feel sad. Rest your leg at night. ",
    "medium": "Treatment with warfarin 25 mg every eight hours was started and tolerated well by the patient on the medical ward. The platelet count was 124 on admission and normalised over the following two days. ",
    "hard": "Longitudinal echocardiographic surveillance substantiated heterogeneous immunosuppressive decompensation, notwithstanding considerable methodological limitations among multimorbid individuals. ",
}


def test_reading_levels(spark):
    docs = [(i * 10 + k, LEVELS[b] * (i % 4 + 1), "en", "s", 1, "clash") for i in range(20) for k, b in enumerate(LEVELS)]
    extra = [(9001, "", "en", None, 1, ""), (9002, None, "en", None, 1, ""), (9003, "12 34", "en", None, 1, ""), (9004, LEVELS["hard"], "de", None, 1, ""), (9005, LEVELS["easy"], None, None, 1, ""), (9006, LEVELS["hard"] * 3000, "en", None, 1, ""), (None, "x", "en", None, 1, "")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, source string, n_chars long, band string")
    truth = {i * 10 + k: b for i in range(20) for k, b in enumerate(LEVELS)}
    labels = [(k, b, "r") for k, b in truth.items() if k < 100] + [(0, "hard", "wrong"), (0, "easy", "r2"), (5, "odd", "r")]
    lab = spark.createDataFrame(labels, "doc_id long, band string, rater string")
    got = {r.doc_id: r.band for r in reading_level.reading_levels(d, lab).collect()}
    assert all(got[k] == b for k, b in truth.items()) and got[9006] == "hard" and {9001, 9002, 9003} <= set(got) and not {9004, 9005, None} & set(got)
    # without labels the formula seeds the bands
    got = {r.doc_id: r.band for r in reading_level.reading_levels(d, lab.limit(0)).collect()}
    assert np.mean([got[k] == b for k, b in truth.items()]) > 0.9
    assert reading_level.reading_levels(d.limit(0), lab).count() == 0


def test_reading_level_accuracy_on_held_out_labels():
    d = "/root/testdata/sf0.1/"
    x = pd.read_parquet(d + "documents.parquet").merge(pd.read_parquet(d + "reading_label.parquet"))
    held = np.arange(len(x)) % 5 == 0
    m = reading_level.fit_models(x.text[~held].tolist(), x.band[~held].tolist())
    assert np.mean([m.band(reading_level.words_of(t)) == b for t, b in zip(x.text[held], x.band[held])]) > 0.95  # a few labels are wrong


CLEAN = "Sleep was poor because of chest tightness, so warfarin was moved to the morning. The wound was clean and the drain came out on day four. Treatment was started and tolerated well. Long-standing asthma needs closer watch."
SCAN = "North Hill Hospital - Lab Report\n$leep was poor because of che5t tightness, so war-\nfarin was moved to the moming. The wourid was clean\nand the drain came out on day four. Treatment was sta-\n\nPage 1 of 2\n\x0cNorth Hill Hospital - Lab Report\n  rted and tolerated well. Long-\nstanding asthma needs closer wa†ch, dose 2O mg.\n- 2 -"


def test_scanned_faults(spark):
    rows = [(f"c{i}", CLEAN, "x") for i in range(30)] + [("s", SCAN, "y"), ("s", SCAN, "y"), ("n", None, ""), ("e", "", ""), (None, SCAN, ""), ("b", "  \n \x0c", ""), ("long", "word " * 100_000, "")]
    d = spark.createDataFrame(rows, "id string, text string, kind string")
    got = {(r.kind, r.start_pos): r.repaired for r in ocr.scanned_faults(d).where("id = 's'").collect()}
    at = SCAN.index
    assert got[("header", 0)] == "" and got[("header", at("North", 5))] == "" and got[("page_number", at("Page 1"))] == "" and got[("page_number", at("- 2 -"))] == ""
    assert got[("hyphen", at("war-"))] == "warfarin" and got[("hyphen", at("sta-"))] == "started" and got[("hyphen", at("Long-"))] == "Long-standing"
    assert got[("misread", at("$leep"))] == "Sleep" and got[("misread", at("che5t"))] == "chest" and got[("misread", at("moming"))] == "morning" and got[("misread", at("wourid"))] == "wound" and got[("misread", at("wa†ch"))] == "watch" and got[("misread", at("2O"))] == "20"
    assert len(got) == 13
    assert {r.id for r in ocr.scanned_faults(d).select("id").distinct().collect()} == {"s"}
    mended = {r.id: r.repaired_text for r in ocr.repair(d).collect()}
    assert mended["s"] == "Sleep was poor because of chest tightness, so warfarin was moved to the morning. The wound was clean and the drain came out on day four. Treatment was started and tolerated well. Long-standing asthma needs closer watch, dose 20 mg." and mended["c1"] == CLEAN and mended["e"] == ""
    assert ocr.scanned_faults(d.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [["no page was scanned here"], ["7", "..."], ["7\n8"], [CLEAN, ""]])
def test_batches_without_words_or_headers(spark, texts):
    """A batch may have no words, pairs, lines or page tops to count."""
    d = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "id string, text string").coalesce(1)
    assert ocr.scanned_faults(d).count() == 0
    assert {r.repaired_text for r in ocr.repair(d).collect()} == set(texts)


@pytest.mark.parametrize("line, page", [("- 7 -", True), ("[12]", True), ("p. 7/9", True), ("Page 3 of 14", True), ("  4", True), ("viii", True), ("Page: 9", True), ("was 12.0.", False), ("mix", False), ("Bay 6.", False), ("2026-03-14", False), ("", False)])
def test_page_numbers(line, page):
    assert ocr.is_page_number(line) == page


def people(spark):
    given, family = ["Ada", "Hugo", "Irene", "Martin", "Zoe", "Emil"], ["Alderby", "Brammore", "Caldholt", "Fenwick", "Larkgard", "Norgard"]
    rows = [(f"r{i}{k}", "s", [("official", f, [g])], None, None, [(None, "Port Halden", "01234")], None, None) for i, g in enumerate(given) for k, f in enumerate(family)]
    rows.append(("x", None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, "record_id string, source_system string, names array<struct<use_code: string, family: string, given: array<string>>>, birth_date date, sex string, addresses array<struct<line: string, city: string, postal_code: string>>, telecom array<struct<system: string, value: string>>, received_at timestamp")


PERSONAL = "Seen by Dr. Ada Fenwick on the round. Next of kin is Hugo\nBrammore, who holds the keys. Tel: (519) 555-0147. E-mail: ada.fenwick@mail.example Registered under SSN 666-35-2440. Lives at 12 N. Quarry Road, Port Halden 01234. Interpreter Norgard, Emil attended the visit."
PLAIN = "A Foley catheter was left in place. Specimen accession 26-387951 was received. Device order 4471-690078-103 remains open. Findings were not typical of Parkinson disease. Port Halden Clinic"


def test_mentions(spark):
    rows = [(f"p{i}", PERSONAL, "x") for i in range(20)] + [(f"q{i}", PLAIN, "x") for i in range(20)] + [("p0", PERSONAL, "x"), ("n", None, ""), ("e", "", ""), (None, PERSONAL, ""), ("long", "word " * 60_000 + PERSONAL, "")]
    d = spark.createDataFrame(rows, "id string, text string, category string")
    got = {(r.id, r.category, r.start_pos) for r in privacy.mentions(d, people(spark)).collect()}
    at = PERSONAL.index
    want = {("name", at("Ada F")), ("name", at("Hugo")), ("name", at("Norgard")), ("phone", at("(519)")), ("email", at("ada.f")), ("identity_number", at("666-")), ("street_address", at("12 N."))}
    assert {(c, s) for i, c, s in got if i == "p3"} == want
    assert {(c, s - 5 * 60_000) for i, c, s in got if i == "long"} == want
    assert not [g for g in got if g[0][0] == "q" or g[0] in ("n", "e")]
    red = {r.id: r.redacted_text for r in privacy.redact(d, people(spark)).collect()}
    assert red["p1"].startswith("Seen by Dr. [NAME] on the round. Next of kin is [NAME], who holds the keys. Tel: [PHONE]. E-mail: [EMAIL]") and red["q1"] == PLAIN and red["e"] == ""
    assert privacy.mentions(d.limit(0), people(spark)).count() == 0 and privacy.mentions(d, people(spark).limit(0)).where("category = 'email'").count() == 21


def test_estimation_beats_votes():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    hit = [0.9, 0.55, 0.8, 0.6]
    patterns, rows = {}, []
    for t in truth:
        v = tuple(int(rng.random() < (h if t else 0.08)) for h in hit) + (0 if t else -int(rng.random() < 0.6),)
        patterns["name", v] = patterns.get(("name", v), 0) + 1
        rows.append(v)
    q = privacy.estimate_reliabilities(patterns)
    assert np.mean([(q["name", v] > 0.5) == t for v, t in zip(rows, truth)]) > 0.93


def test_short_items_count_as_a_whole(spark):
    items = spark.createDataFrame([(1, "Aspirin"), (2, "acute renal failure"), (3, ""), (4, "mild persistent asthma")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "Give aspirin for ACUTE renal, failure."), (11, "renal failure, acute"), (12, None), (13, "persistent asthma")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == {(10, 1), (10, 2)}


def test_covered_equals_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(300):
        found = []
        for _ in range(rng.randrange(12)):
            i, d, n = rng.randrange(30), rng.randrange(60), rng.randrange(1, 9)
            found.append((i, i + n, d, d + n + rng.randrange(2)))
        most = max([p[1] - p[0] for p in found] + [a[1] - a[0] + b[1] - b[0] for a in found for b in found if a[1] <= b[0] and a[3] <= b[2]], default=0)
        assert leakage.covered(found) == most


def test_names_are_found_without_records(spark):
    """Without a gazetteer, letters and neighbours tell names."""
    plain = "the wound was clean and dry and the patient slept well after the dressing was changed by day. "
    names = ["Belmira Tarnholt", "Oskar Quillby", "Yusra Fennow", "Anselm Drexmore", "Ilka Vostrand"]
    rows = [(f"t{k}", plain + f"Discussed with Dr {names[k % 5]} on the ward round. {plain}Spoke with {names[(k + 1) % 5]} who agreed.") for k in range(60)]
    texts = spark.createDataFrame(rows, "id string, text string")
    records = spark.createDataFrame([], "names array<struct<family: string, given: array<string>>>, addresses array<struct<city: string>>")
    found = {(r.id, r.start_pos) for r in privacy.mentions(texts, records).where("category = 'name'").collect()}
    truth = {(i, t.index(n)) for i, t in rows for n in names if n in t}
    assert len(found & truth) > 0.9 * len(truth) and len(found - truth) < 0.1 * len(truth)
