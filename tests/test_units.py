import re
from fractions import Fraction

import pandas as pd
import pytest

from corvane.operators.units import conversion, observations_to_convert, segmentations

CODES = "code_key string, common_unit string, molar_mass double"
FACTS = "observation_key string, code_key string, value double, unit string, value_text string, milli string"


@pytest.mark.parametrize(
    "text, common, mass, factor",
    [
        ("mg/dL", "mmol/L", 180.156, Fraction(10) / Fraction("180.156")), ("mg%", "mmol/L", 180.156, Fraction(10) / Fraction("180.156")), ("g/100mL", "g/L", None, 10), ("MG/DL", "umol/L", 113.12, 10000 / Fraction("113.12")),
        ("M", "cm", None, 100), ("MM", "cm", None, Fraction(1, 10)), ("mM", "mmol/L", None, 1), ("ukat/L", "U/L", None, 60), ("K/uL", "10^9/L", None, 1), ("/cumm", "10^9/L", None, Fraction(1, 1000)),
        ("kPa", "mm[Hg]", None, 1000 / Fraction("133.322387415")), ("stone", "kg", None, 14 * Fraction("0.45359237")), ("US fl oz", "mL", None, Fraction("29.5735295625")), ("in.", "cm", None, Fraction("2.54")),
        ("thou/mm3", "10^9/L", None, 1), ("x10^9/L", "10^9/L", None, 1), ("mg per dL", "mmol/L", 40.078, 10 / Fraction("40.078")),
    ],
)
def test_conversion_factors(text, common, mass, factor):
    a, b, d, same = conversion(text, common, mass, False)
    assert Fraction(a, d) == factor and b == 0 and same == (factor == 1)


def test_offsets_and_free_text():
    a, b, d, same = conversion("[degF]", "Cel", None, False)
    assert Fraction(a * 212 + b, d) == 100 and not same
    for text in ("reported in mmol/L", "(mmol/L)", "unit: mmol/L", "units = mmol/L; repeat sample", "result  mmol / L *"):
        assert conversion(text, "mmol/L", None, True)[3], text
    assert conversion("see comment", "mmol/L", None, True) is None
    assert conversion("kg", "mmol/L", None, False) is None
    assert conversion(None, "mmol/L", None, True) is None and conversion("", "cm", None, True) is None
    assert segmentations("") == ()


def test_observations(spark):
    codes = spark.createDataFrame([("glu", "mmol/L", 180.156), ("tmp", "Cel", None), ("wbc", "10^9/L", None), ("ml", "mL", None)], CODES)
    rows = [
        ("a", "glu", 90.078, "mg/dL", None, "x"), ("a", "glu", 90.078, "mg/dL", None, "x"),  # loaded twice
        ("b", "glu", 5.0, "mmol/l", None, None),  # same size: no case
        ("c", "glu", 5.0, None, "(mmol/L)", None), ("d", "glu", None, None, "result 5,4 mmol/L", None),
        ("e", "tmp", 98.6, "F", None, None), ("f", "wbc", None, None, "5,250 /uL", None), ("g", "wbc", None, None, "7.4 x10^9/L", None),
        ("h", "glu", None, "mg/dL", None, None), ("i", "glu", 4.0, None, None, None), ("j", None, 4.0, "mg/dL", None, None), (None, "glu", 4.0, "mg/dL", None, None),
        ("k", "glu", 4.0, "mmol/L", "see comment", None), ("l", "ml", 0.0015, "L", None, None), ("m", "glu", 4.0, " ", "see comment", None), ("n", "glu", 1.0, "furlong", None, None), ("o", "glu", 1.0, "mg/dL" + " " * 5000, None, None),
    ]
    got = {r.observation_key: r.value_milli for r in observations_to_convert(spark.createDataFrame(rows, FACTS), codes).collect()}
    assert got == {"a": 5000, "c": 5000, "d": 5400, "e": 37000, "f": 5250, "g": 7400, None: 222, "l": 1500, "o": 56}
    assert observations_to_convert(spark.createDataFrame([], FACTS), codes).count() == 0


def test_rounding_is_half_up_and_exact(spark):
    codes = spark.createDataFrame([("w", "kg", None)], CODES)
    values = [0.0005, 0.0015, 2.5, 154.3235, 1.0000001]
    rows = [(str(i), "w", v, "g", None, None) for i, v in enumerate(values)]
    got = {r.observation_key: r.value_milli for r in observations_to_convert(spark.createDataFrame(rows, FACTS), codes).collect()}
    for i, v in enumerate(values):
        x = Fraction(str(v)) / 1000 * 1000
        assert got[str(i)] == (2 * x.numerator + x.denominator) // (2 * x.denominator)


def test_every_unit_of_the_data_is_read():
    d = "/root/testdata/sf0.01/"
    o = pd.read_parquet(d + "fact_observation.parquet").merge(pd.read_parquet(d + "code_unit.parquet"))
    for unit, common, mass in o[["unit", "common_unit", "molar_mass"]].dropna(subset=["unit"]).drop_duplicates().itertuples(index=False):
        assert conversion(unit, common, mass, False), (unit, common)
    assert not re.search("[^0-9]", "1")


def test_many_readings_before_the_unit_keep_it():
    assert segmentations("mg/dL")[0][1:3] in {r[1:3] for r in segmentations("g m s h L g m s h L g m s K in mg/dL", free=True)}


def test_values_of_any_size_keep_their_digits(spark):
    codes = spark.createDataFrame([("u", "umol/L", 100.0), ("w", "kg", None), ("t", "Cel", None)], CODES)
    rows = [
        ("small", "u", 8.8437e-5, "mol/L", None, None), ("large", "w", 1e13, "g", None, None), ("beyond", "w", 1e300, "g", None, None), ("nan", "w", float("nan"), "g", None, None),
        ("inf", "w", float("-inf"), "g", None, None), ("negative", "w", -1.5e-3, "t", None, None), ("tiny", "u", 1e-30, "mol/L", None, None), ("cold", "t", -40.0, "[degF]", None, None), ("long", "w", 123456789012.34567, "g", None, None),
    ]
    got = {r.observation_key: r.value_milli for r in observations_to_convert(spark.createDataFrame(rows, FACTS), codes).collect()}
    assert got == {"small": 88437, "large": 10**13, "negative": -1500, "tiny": 0, "cold": -40000, "long": 123456789012}
