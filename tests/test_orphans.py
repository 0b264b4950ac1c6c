from datetime import datetime as T

from pyspark.sql import functions as F

from tamarack.operators import orphans

REFS = "from_table string, row_id long, col_name string, parent string, key string, number long, at timestamp_ntz"
PARENTS = "parent string, key string, number long, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def found(spark, refs, parents):
    r = spark.createDataFrame([("t", i, "c", p, k, int(k) if k.isdigit() else None, at) for i, (p, k, at) in enumerate(refs)], REFS)
    p = spark.createDataFrame([(p, k, int(k) if k.isdigit() else None, a, b) for p, k, a, b in parents], PARENTS)
    return {x["row_id"]: x["reason"] for x in orphans.orphan_references(r, p).collect()}


def test_reasons(spark):
    parents = [("p", "1", T(2020, 1, 10), None), ("p", "2", T(2020, 1, 10), T(2020, 3, 5)), ("p", "2", T(2020, 6, 1), None), ("e", "recA", T(2020, 1, 1), None)]
    refs = [
        ("p", "1", T(2020, 1, 9)),
        ("p", "1", T(2020, 1, 10)),
        ("p", "1", T(2024, 1, 1)),
        ("p", "2", T(2020, 2, 1)),
        ("p", "2", T(2020, 3, 5)),
        ("p", "2", T(2020, 4, 1)),
        ("p", "2", T(2020, 6, 1)),
        ("p", "3", T(2020, 1, 1)),
        ("e", "recA", T(2020, 5, 1)),
        ("e", "reca", T(2020, 5, 1)),
        ("x", "1", T(2020, 5, 1)),
    ]
    assert found(spark, refs, parents) == {0: "late", 4: "deleted", 5: "deleted", 7: "missing", 9: "missing", 10: "missing"}


def test_nulls_and_empty(spark):
    assert found(spark, [("p", "1", None)], [("p", "1", None, None)]) == {}
    assert found(spark, [("p", "1", T(2020, 1, 1))], [("p", "1", None, T(2019, 1, 1))]) == {0: "deleted"}
    assert found(spark, [("p", "1", T(2020, 1, 1))], []) == {0: "missing"}
    assert found(spark, [], [("p", "1", None, None)]) == {}


def test_hot_key_and_word_limits(spark):
    """Keys at the edges of a 64-bit range, one of them referred to again and again."""
    keys = [0, 63, 64, 127, 128, 2**40]
    parents = [("p", str(k), T(2020, 1, 1), None) for k in keys]
    refs = [("p", str(k), T(2021, 1, 1)) for k in keys for _ in range(30)] + [("p", str(k + 1), T(2021, 1, 1)) for k in keys] * 2
    got = found(spark, refs, parents)
    there = {str(k) for k in keys}
    assert got == {i: "missing" for i, (_, k, _) in enumerate(refs) if k not in there}


def test_large_dictionary_goes_through_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(orphans, "BROADCAST_ROWS", 1)
    parents = [("e", f"rec{i}x", T(2020, 1, 1), None) for i in range(20)] + [("p", "7", T(2020, 1, 1), None)]
    refs = [("e", f"rec{i}x", T(2021, 1, 1)) for i in range(25)] + [("p", "7", T(2021, 1, 1)), ("p", "8", T(2021, 1, 1))]
    assert found(spark, refs, parents) == {**{i: "missing" for i in range(20, 25)}, 26: "missing"}


def test_spellings(spark):
    from tamarack.functions.keys import entity_number, is_known, stripped

    df = spark.createDataFrame([(x,) for x in ["2000123", " 2000123", "PT-2000123", "pt 2000123", "02000123", "2000123.0", "2000123A", "", "nan", "N/A", None, '"recA1"', "recA1\t"]], "v string")
    got = df.select(entity_number(F.col("v")), is_known(F.col("v")), stripped(F.col("v"))).collect()
    assert [r[0] for r in got[:6]] == ["2000123"] * 6
    assert got[6][0] is None
    assert [r[1] for r in got] == [True] * 7 + [False] * 4 + [True] * 2
    assert [r[2] for r in got[-2:]] == ["recA1", "recA1"]
