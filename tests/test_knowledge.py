import pytest
from pyspark.sql import functions as F

from tamarack.operators import graph, guards, knowledge, lookup, memory, merge, profile, rules
from tamarack.operators.rules import FilterTerm
from tamarack.plans import inspect, planner


def star(spark):
    return {
        "city": spark.createDataFrame([(1, "Bonn"), (2, "Lima"), (3, None)], "city_id int, city_name string"),
        "person": spark.createDataFrame([(10, 1, "Ann"), (11, 1, "Bob"), (12, 2, "bonn"), (13, None, "")], "person_id int, city_id int, person_name string"),
    }


def test_graph_lookups(spark):
    g = knowledge.build_graph(spark, star(spark))
    assert [tuple(r)[:4] for r in g.keys.collect()] == [("person", "city_id", "city", "city_id")]
    assert {(r["table_name"], r["exact"]) for r in g.find_value("BONN").collect()} == {("city", True), ("person", True)}
    assert g.between("city", "person").count() == 1 and g.between("city", "nowhere").count() == 0
    assert {tuple(r) for r in g.neighbours("city").where("way <> 'similar'").collect()} == {("person", "referred_by")}
    assert {r["text"] for r in g.tables_text().where("table_name = 'city'").collect()} == {"city_id int 1.000, city_name string 0.667"}
    assert {(r["table_name"], r["row_count"], r["refers_to"], r["referred_by"]) for r in g.overview().collect()} == {("city", 3, 0, 1), ("person", 4, 1, 0)}
    assert g.resolve("lima").collect()[0]["how"] == "value" and g.resolve("lim").collect()[0]["how"] == "near" and g.resolve("zzz").count() == 0


def test_new_tables_extend_the_graph(spark):
    tables = star(spark)
    g = knowledge.build_graph(spark, {"city": tables["city"]})
    more = knowledge.extend_graph(spark, g, {"city": tables["city"]}, {"person": tables["person"], "city": tables["person"]})
    assert [tuple(r)[:4] for r in more.keys.collect()] == [("person", "city_id", "city", "city_id")]
    assert more.columns.count() == 5 and knowledge.extend_graph(spark, more, tables, tables) is more


def test_empty_tables_have_a_graph(spark):
    g = knowledge.build_graph(spark, {"a": spark.createDataFrame([], "a_id int, name string"), "b": spark.createDataFrame([], "b_id int, a_id int")})
    assert g.keys.count() == 0 and g.values.count() == 0 and g.columns.count() == 4


def test_name_similarity():
    assert graph.name_similarity("Name", "string", "name", "int") == 1.0
    assert graph.name_similarity("school_name", "string", "name", "int") == 0.5 and graph.name_similarity("school_name", "string", "name", "string") == 0.6
    assert graph.name_similarity("patients", "int", "patient_key", "int") == 0.3  # stems count only where no word is common
    assert graph.name_similarity("school_name", "string", "school_city_code", "string") == 0.0 and graph.name_similarity("a", "x", "b", "x") == 0.0


def test_phrases_and_paths():
    score = planner.score_column
    assert score("price", "price", is_filter=False) == 10 and score("the price now", "price", is_filter=False) == 8
    assert score("school names", "name of a school", is_filter=False) == 6 + 3
    assert score("big town", "city", "a town or big place", is_filter=False) == 3.0
    assert score("> 5", "size", kind="double") == 3.0 and score("bonn", "city", samples=("Bonn",), kind="string", distinct=200) == 8 + 2 + 2
    assert score("zzz", "city", is_filter=False) == 0
    near = planner.map_phrase("price", [planner.ColumnFacts("a", "price"), planner.ColumnFacts("b", "cost")], is_filter=False, similar={("a", "price"): {("b", "cost"): 0.8}})
    assert near == [(10.0, "a", "price"), (4.0, "b", "cost")]
    edges = planner.similarity_edges([planner.Edge("a", "x", "b", "x")], [("hero_power", "hero_id", "superhero", "id", 0.6), ("a", "b_id", "b", "id", 1.0), ("c", "note", "d", "note", 1.0)])
    assert [(e.source, e.target, round(e.weight, 2)) for e in edges] == [("hero_power", "superhero", 0.24)]


def test_contained_names_of_any_number(spark):
    names = spark.createDataFrame([(i, f"Name {i:05d} of all") for i in range(10_000)] + [(77777, "of all"), (None, "x"), (5, None), (6, "")], "key int, name string")
    texts = spark.createDataFrame([("see name 00042 OF ALL, please",), ("one of all",), ("nothing",), (None,), ("",)], "t string")
    got = {r["t"]: r["t_key"] for r in lookup.resolve_contained(texts, "t", names).collect()}
    assert got == {"see name 00042 OF ALL, please": "42", "one of all": "77777", "nothing": None, None: None, "": None}
    assert lookup.resolve_contained(texts, "t", names.limit(0)).where("t_key is not null").count() == 0


def test_hints(spark):
    tables = star(spark)
    got = {(r["kind"], r["place"]) for r in lookup.zero_row_hints(tables, "person", "person_name", "Lima", [("person", "city_id", "city", "city_id")]).collect()}
    assert got == {("elsewhere", "city.city_name"), ("related", "city.city_name")}
    assert {r["kind"] for r in lookup.zero_row_hints(tables, "person", "person_name", "qqq").collect()} == {"sample"}


def test_plan_parts(spark):
    spark.range(5).selectExpr("id", "id * 2 as v").createOrReplaceTempView("t_plan")
    df = spark.sql("SELECT id, v FROM t_plan WHERE (id > 1 AND v < 9) AND (id = 2 OR v = 4) ORDER BY v DESC LIMIT 3")
    assert len(inspect.conjuncts(df)) == 3 and inspect.order_and_limit(df) == ("v DESC NULLS LAST", 3)
    assert inspect.order_and_limit(spark.range(1)) == ("", None)
    assert inspect.quoted_sql("nothing") is None and inspect.where_of("`select a from t`") is None
    spark.range(5).selectExpr("id", "id * 3 as w").createOrReplaceTempView("t_other")
    both = spark.sql("SELECT a.id, b.w AS x, a.v + b.w AS s FROM t_plan a JOIN t_other b ON a.id = b.id")
    assert inspect.output_origins(both) == {"id": "t_plan", "x": "t_other", "s": ""} and "id" in inspect.join_columns(both)
    assert guards.wrong_column(both, {"x": "t_plan"}) and not guards.wrong_column(both, {"id": "t_other", "x": "t_other"})


def test_hypotheses_and_adaptation(spark):
    df = spark.createDataFrame([(i % 10, float(i), "A" if i % 2 else "B") for i in range(40)], "e int, v double, k string")
    terms = [FilterTerm("v", ">", 100), FilterTerm("k", "=", "A")]
    e = rules.gather_evidence(df, "e", terms)
    assert e.kept == {"0": 0, "1": 20} and e.dropped == {"": 0, "0": 5, "1": 0} and e.rows_per_entity == 4
    found = {h.label for h in rules.hypotheses(df, "e", terms, "the top 10 % and the latest", e)}
    assert {"as_is", "without_v", "any_of", "wider_v", "inverted_v", "percent_v", "like_k", "not_zero_v", "latest", "across_rows"} <= found
    best = rules.best_hypothesis(df, "e", terms)
    assert best is not None and df.where(best.condition()).count() > 0
    after, log = rules.adapt({"t": df}, "t", "e", terms)
    assert after != terms and any("outside" in x for x in log)
    assert rules.adapt({"t": df.limit(0)}, "t", "e", terms)[0] == terms
    assert rules.assess_plausibility(df, "e", terms, "ratio").plausible


def test_ratios_and_normal_ranges(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 50.0), (2, 60.0), (3, None)], "e int, v double")
    value = lambda kind, *t: rules.ratio(df, "e", list(t), kind).first()[0]
    big, small = FilterTerm("v", ">", 20), FilterTerm("v", "<", 20)
    assert value("percentage", big) == 50.0 and value("entities", big) == pytest.approx(66.666667) and value("increase", small, big) == 2.0
    assert rules.ratio_pattern([big], "average") is None
    rules_used = [p.rule for p in rules.repair(df, "e", [FilterTerm("v", "=", "abnormal")], "v: 10-55")]
    assert rules_used[0] == "normal_range"


def test_small_operators(spark, tmp_path):
    assert profile.approximate_fences(0, 8, 4) == (-1.0, 9.0) and profile.linear_percentile(0, 10, 20) == 8.0 and profile.linear_percentile(0, 10, 20, top=False) == 2.0
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y")], "id int, a string, b string")
    assert merge.detect_id_key(df, ["zz", "a", "b"]) == "b" and merge.detect_id_key(df.limit(0), ["b"]) is None and merge.detect_id_key(df, []) is None
    assert [tuple(r) for r in merge.merge_case_variants(df.toDF("id", "Name", "NAME")).orderBy("id").collect()] == [(1, "x"), (2, "y")]
    facts = spark.createDataFrame([("n", "s", "f")], "node string, subject string, fact string")
    memory.save_facts(facts, str(tmp_path), "abc")
    memory.save_facts(facts.limit(0), str(tmp_path), "def")
    assert memory.load_facts(spark, str(tmp_path), "abc").count() == 1 and memory.load_facts(spark, str(tmp_path), "none") is None
    assert knowledge.ambiguous_references(spark, "SELECT 1") == [] and knowledge.render_grounding({"b": [1, 2], "a": "x"}) == "a: x\nb: 1, 2"
    assert lookup.best_paragraph_per_document(spark.createDataFrame([(1, "cat\n\ncat dog"), (2, None)], "doc_id long, text string"), "cat dog").collect()[0]["place"] == 1
    assert profile.null_shares(df.limit(0)).where(F.col("null_ratio") != 0).count() == 0


def test_guard_chain(spark):
    many = spark.range(600).selectExpr("id")
    context = guards.Context(docs=spark.createDataFrame([(1, "see recABCDEFGH1 here")], "doc_id long, text string"))
    ids = spark.createDataFrame([("recABCDEFGH1",)], "link_to_event string")
    assert [o.guard for o in guards.check(many)] == ["row_cap"] and [o.guard for o in guards.check(ids, context)] == ["fk_resolution"]
    assert guards.check(ids) == [] and guards.check(ids.limit(0), context) == []
