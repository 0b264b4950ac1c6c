import json
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tamarack.functions import quantities
from tamarack.functions.affine import Affine, UnitGraph
from tamarack.operators import units
from tamarack.operators.units import canonical_values, other_units

COLUMNS = [
    ("lab", "glu_mmol_l", None), ("lab", "GLU (mg/dL)", ""), ("lab", "hgb", "(g/l) haemoglobin"), ("lab", "ua", "uric acid in micromol/L"), ("lab", "fasting_glucose", None), ("lab", "WBC", "white blood cells"),
    ("hero", "height", "body height in in."), ("hero", "tall", None), ("hero", "weight_kg", None), ("use", "usage", "energy drawn over the period"), ("lab", "record_id", None),
]


def values(spark, *cases):
    """(table, column, value) -> {place: (quantity, unit, value in the common unit)}"""
    rows = [(i, t, json.dumps({c: {"value": v, "confidence": "high", "is_correction": False}})) for i, (t, c, v) in enumerate(cases)]
    records = spark.createDataFrame(rows, "row_id long, source_table string, fields_json string")
    columns = spark.createDataFrame(COLUMNS, "in_table string, col_name string, description string")
    return {r["row_id"]: (r["quantity"], r["unit"], round(r["value"], 3)) for r in canonical_values(records, columns).collect()}


def test_reading(spark):
    cases = {
        ("lab", "glu_mmol_l", "6.53"): ("glu", "mmol/L", 117.642),
        ("lab", "glu_mmol_l", "was 112.0 MG/DL on arrival"): ("glu", "mg/dL", 112.0),
        ("lab", "GLU (mg/dL)", 94.8): ("glu", "mg/dL", 94.8),
        ("lab", "hgb", "140"): ("hgb", "g/L", 14.0),
        ("lab", "hgb", "g/dL: 13,64"): ("hgb", "g/dL", 13.64),
        ("lab", "ua", "357"): ("ua", "umol/L", 6.002),
        ("lab", "fasting_glucose", "5.5"): ("glu", "mmol/L", 99.086),
        ("lab", "fasting_glucose", "99"): ("glu", "mg/dL", 99.0),
        ("lab", "WBC", "18,127per µL"): ("wbc", "/uL", 18.127),
        ("lab", "WBC", "20.4410^3/µL"): ("wbc", "10^3/uL", 20.44),
        ("lab", "WBC", "10^3/µL: 8.70"): ("wbc", "10^3/uL", 8.7),
        ("lab", "WBC", "5.40x10³/uL"): ("wbc", "10^3/uL", 5.4),
        ("lab", "WBC", "6000"): ("wbc", "/uL", 6.0),
        ("hero", "height", "69.3"): ("height", "in", 176.022),
        ("hero", "height", "5'11\""): ("height", "ft", 180.34),
        ("hero", "height", "6 feet 8"): ("height", "ft", 203.2),
        ("hero", "tall", "2.03"): ("height", "m", 203.0),
        ("hero", "tall", "183"): ("height", "cm", 183.0),
        ("hero", "weight_kg", "57,356 g"): ("weight", "g", 57.356),
        ("use", "usage", "0.0649 mwh"): ("consumption", "MWh", 64.9),
        ("use", "usage", "524.0 megajoules"): ("consumption", "MJ", 145.556),
    }
    assert values(spark, *cases) == dict(enumerate(cases.values()))


def test_nothing_to_read(spark):
    assert values(spark, *(("lab", "hgb", v) for v in (None, "", " ", "-", "NaN", "not recorded", "not available (nan)", "unavailable", "high"))) == {}
    assert values(spark, ("lab", "record_id", "12"), ("nowhere", "x", "12")) == {}
    assert values(spark, ("nowhere", "serum_creatinine", "1.1")) == {0: ("cre", "mg/dL", 1.1)}


def test_bad_json_empty_and_clashing_columns(spark):
    columns = spark.createDataFrame(COLUMNS, "in_table string, col_name string, description string")
    schema = "row_id long, source_table string, fields_json string, unit string, value int, note string"
    records = spark.createDataFrame([(1, "lab", "not json", "u", 1, "n"), (2, "lab", None, "u", 1, "n"), (3, None, '{"hgb": {"value": "1"}}', "u", 1, "n"), (4, "lab", '{"hgb": {"value": "13 g/dL"}}', "u", 1, "kept")], schema)
    got = canonical_values(records, columns)
    assert [(r["row_id"], r["unit"], r["note"]) for r in got.collect()] == [(4, "g/dL", "kept")]
    assert other_units(canonical_values(records.limit(0), columns)).count() == 0


def test_other_spellings_of_the_common_unit_are_no_cases(spark):
    rows = [(i, "lab", json.dumps({"GLU (mg/dL)": {"value": v}})) for i, v in enumerate(["90 mg/dl", "90 MG/DL", "90 mg per dL", "90 mg/100 mL", "5 mmol/l"])]
    records = spark.createDataFrame(rows, "row_id long, source_table string, fields_json string")
    columns = spark.createDataFrame(COLUMNS, "in_table string, col_name string, description string")
    assert [tuple(r) for r in other_units(canonical_values(records, columns)).collect()] == [(4, "glu")]


def test_graphs_have_consistent_cycles():
    for row in quantities.conversion_table():
        assert row[3] > 0 and row[6] < row[7]


def test_inconsistent_cycle_is_refused():
    graph = UnitGraph({("a", "b"): Affine(2.0), ("b", "c"): Affine(3.0), ("a", "c"): Affine(7.0)})
    with pytest.raises(ValueError):
        graph.check_cycles()


@given(st.floats(-1e3, 1e3).filter(lambda a: abs(a) > 1e-3), st.floats(-1e3, 1e3), st.floats(-1e3, 1e3))
def test_affine_round_trip(a, b, x):
    f = Affine(a, b)
    assert math.isclose(f.inverse()(f(x)), x, rel_tol=1e-6, abs_tol=1e-4)


def test_values_are_read_without_python(spark, sf):
    """Only the meanings of the column names pass through Python, before the values are read."""
    from tamarack.plans.inspect import executed

    assert "EvalPython" not in executed(units.values_of(spark, sf))
