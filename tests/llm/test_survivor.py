import json
import random
from datetime import datetime as T

from tamarack.llm.survivor import _TOKEN, align, built_records, consensus_values, grouped_values, slots, surviving_values, with_record

SCHEMA = "row_id long, record_id string, entity_type string, source_table string, fields_json string, ambiguous_fields array<string>, extracted_at timestamp, quantity string, place int"


def row(i, record, entity, fields, ambiguous=(), at=None):
    return (i, record, entity, "lab", json.dumps({k: {"value": v, "confidence": c, "is_correction": f} for k, (v, c, f) in fields.items()}), list(ambiguous), at, "clash", 3)


def grouped(spark, *rows):
    columns = spark.createDataFrame([("lab", "hgb", "(g/dl)"), ("lab", "ua", "uric acid, mg/dL")], "in_table string, col_name string, description string")
    return grouped_values(spark.createDataFrame(list(rows), SCHEMA), columns)


def survivors(spark, *rows):
    return surviving_values(grouped(spark, *rows))


def chosen(spark, *rows):
    return {(r["record"], r["quantity"]): r["row_id"] for r in survivors(spark, *rows).collect()}


def test_order_of_preference(spark):
    r = "3000012_2010-08-08"
    day1, day2 = T(2020, 1, 1), T(2021, 1, 1)
    assert chosen(spark, row(1, r, "laboratory", {"hgb": ("-", "high", False)}), row(2, r, "laboratory", {"hgb": ("12", "low", False)})) == {("3000012|2010-08-08", "hgb"): 2}
    assert list(chosen(spark, row(1, r, "laboratory", {"hgb": ("12", "high", True)}, ["hgb"]), row(2, r, "laboratory", {"hgb": ("13", "low", False)})).values()) == [2]
    assert list(chosen(spark, row(1, r, "laboratory", {"hgb": ("12", "medium", True)}), row(2, r, "laboratory", {"hgb": ("13", "high", False)})).values()) == [2]
    assert list(chosen(spark, row(1, r, "laboratory", {"hgb": ("12", "high", False)}, at=day2), row(2, r, "laboratory", {"hgb": ("13", "high", True)}, at=day1)).values()) == [2]
    assert list(chosen(spark, row(1, r, "laboratory", {"hgb": ("12", "high", False)}), row(2, r, "laboratory", {"hgb": ("13", "high", False)}, at=day1)).values()) == [2]
    assert list(chosen(spark, row(2, r, "laboratory", {"hgb": ("12", "high", False)}, at=day1), row(1, r, "laboratory", {"hgb": ("13", "high", False)}, at=day1)).values()) == [1]


def test_one_record_many_spellings(spark):
    forms = ["3000012_2010-08-08", "PT-3000012_2010/8/8", "03000012_20100808", "3000012.0_August 8, 2010", "3000012_8 August 2010", " 3000012_2010-8-8 "]
    df = spark.createDataFrame([(f, "Laboratory") for f in forms] + [("513214_201307", "usage"), ("C513214_July 2013", "Usage"), ("513214 _ 2013-07", "usage"), ("hero 77", "superhero"), ("#77", "superhero"), ("Hero-000077", "superhero"), ("77.0", "Superhero"), ("odd id", "superhero"), (None, "usage"), ("1_201301", None), ("nan", "usage")], "record_id string, entity_type string")
    got = [(r["entity"], r["record"]) for r in with_record(df).collect()]
    assert got[:6] == [("laboratory", "3000012|2010-08-08")] * 6 and len(set(got[6:9])) == 1 and got[9:13] == [("superhero", "77")] * 4
    assert got[13:] == [("superhero", "odd id")]


def test_single_rows_and_missing_values_give_nothing(spark):
    assert chosen(spark, row(1, "1_20100101", "laboratory", {"hgb": ("12", "high", False)})) == {}
    r = "1_20100101"
    assert chosen(spark, row(1, r, "laboratory", {"hgb": ("-", "high", False)}), row(2, r, "laboratory", {"ua": ("5", "high", False)})) == {("1|2010-01-01", "ua"): 2}
    assert survivors(spark, row(1, r, "laboratory", {})).limit(0).count() == 0


def test_hot_record(spark):
    rows = [row(i, "9", "superhero", {"hgb": (str(5 + i % 7), "low", False)}) for i in range(2000)] + [row(5000, "9", "superhero", {"hgb": ("17 g/dL", "high", False)})]
    assert chosen(spark, *rows) == {("9", "hgb"): 5000}
    built = built_records(consensus_values(grouped(spark, *rows))).collect()
    # Two thousand rows of low confidence outvote one; 5 to 9 have 286 votes each, and a tie in a column goes to the greater token.
    assert [r["fields"] for r in built] == [{"hgb": 9.0}]


def brute(values):
    """The consensus of (value text, weight, place in the order), straight from the description."""
    head = min(values, key=lambda v: v[2])[0]
    rows = [dict(x.split(" ", 1) for x in slots(head, t)) for t, _, _ in values]
    columns = {c for r in rows for c in r}
    winner = {}
    for c in columns:
        votes = {}
        for r, (_, w, _) in zip(rows, values, strict=True):
            votes[r.get(c)] = votes.get(r.get(c), 0) + w
        winner[c] = max(votes, key=lambda t: (votes[t], t is not None, t or ""))
    off = [sum(r.get(c) != winner[c] for c in columns) for r in rows]
    return values[min(range(len(values)), key=lambda k: (off[k], values[k][2]))][0]


def test_consensus_against_brute_force(spark):
    rng = random.Random(4)
    rows, groups = [], {}
    for g in range(60):
        for k in range(rng.randrange(2, 6)):
            value, confidence, fixed = rng.choice(["12.5", "12.51", "12.7", "13.5", "13", "7.25"]), rng.choice(["high", "medium", "low"]), rng.random() < 0.3
            i = len(rows)
            rows.append(row(i, str(g + 1), "superhero", {"hgb": (value, confidence, fixed)}))
            rank = {"high": 3, "medium": 2, "low": 1}[confidence]
            groups.setdefault(str(g + 1), []).append((str(float(value)), 3 * (1 + rank) * (1 + fixed), (-rank, not fixed, i)))
    want = {}
    for g, values in groups.items():
        merged = {}
        for t, w, o in values:
            old = merged.get(t, (0, o))
            merged[t] = (old[0] + w, min(old[1], o))
        want[g] = float(brute([(t, w, o) for t, (w, o) in merged.items()]))
    got = {r["record"]: r["value"] for r in consensus_values(grouped(spark, *rows)).collect()}
    assert got == want


def test_majority_of_a_tier_outvotes_the_first_place(spark):
    r = "1_20100101"
    rows = [row(1, r, "laboratory", {"hgb": ("12.5 g/dL", "high", False)}), row(2, r, "laboratory", {"hgb": ("125 g/l", "high", False)}), row(3, r, "laboratory", {"hgb": ("17.5", "high", False)}, at=T(2024, 1, 1))]
    assert list(chosen(spark, *rows).values()) == [3]
    assert [(x["value"], x["votes"], x["voters"]) for x in consensus_values(grouped(spark, *rows)).collect()] == [(12.5, 24, 36)]


def test_alignment_and_slots():
    assert align(list("abc"), list("ac")) == [(0, 0), (1, None), (2, 1)]
    assert slots("12.5", "12.7") == ["0 12", "1 .", "2 7"]
    assert slots("12", "12.7") == ["0 12", "0+1 .", "0+2 7"] and slots("12.5", "") == []
    assert _TOKEN.findall("-1.5E7") == ["-", "1", ".", "5", "E", "7"]
