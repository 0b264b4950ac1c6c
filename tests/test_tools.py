import itertools
import json

import pytest
from pyspark.sql import functions as F

from tamarack.functions.json_repair import repair_json, repaired
from tamarack.operators import documents, lookup, memory
from tamarack.queries import tools


def test_json_repair(spark):
    cases = {
        '{"a": 1}': '{"a": 1}',
        "Sure:\n```json\n{\"a\": [1, 2,],}\n```": '{"a": [1, 2]}',
        "<think>{no}</think> [1, 2, {\"b\": \"x": '[1, 2, {"b": "x"}]',
        '{"rows": [{"a": 1}, {"a": 2}, {"a"': '{"rows": [{"a": 1}, {"a": 2}]}',
        "no json": None,
        "": None,
        None: None,
    }
    assert {k: repair_json(k) for k in cases} == cases
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(repaired(F.col("t"))).collect()] == list(cases.values())


def longest_json(reply):
    """Brute force: the longest beginning of what follows the first bracket that some closers make whole."""
    starts = [k for k in (reply.find("{"), reply.find("[")) if k >= 0]
    text = reply[min(starts) :] if starts else ""
    closers = ["".join(c) for n in range(5) for c in itertools.product('"]}', repeat=n)]
    for n, c in itertools.product(range(len(text), 0, -1), closers):
        try:
            return json.dumps(json.loads(text[:n] + c), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def test_every_reply_is_repaired(spark, tmp_path):
    whole = '{"action": "run", "action_input": {"sql": "SELECT 1", "rows": [1, {"k": "{"}]}}'
    replies = [whole, f"```json\n{whole}\n```", f"Done:\n{whole} That is all.", whole[:-1], whole[:-3], whole[:48], "no json", "", None]
    spark.createDataFrame(list(enumerate(replies)), "step_id long, raw_response string").coalesce(1).write.parquet(str(tmp_path / "step_record.parquet"))
    got = {r["step_id"]: r["reply"] for r in tools.QUERIES["json_replies"](spark, str(tmp_path)).collect()}
    assert got == {i: longest_json(r or "") for i, r in enumerate(replies)}
    assert got[1] == got[2] == got[3] == json.dumps(json.loads(whole), sort_keys=True) and got[5] and got[7] is None


def test_lookup(spark):
    assert lookup.term_matches("customer_name", ["customers"]) and not lookup.term_matches("price", ["weight"])
    assert lookup.token_overlap("a b c", "b c") == 1.0 and lookup.token_overlap("", "x") == 0.0
    df = spark.createDataFrame([(1, "Alpha"), (2, "007"), (3, None), (4, "alphabet")], "k int, t string")
    assert sorted(tuple(r) for r in lookup.empty_filter_hints(df, "t", "alpha").collect()) == [("Alpha", "case", 1), ("alphabet", "prefix", 1)]
    assert [tuple(r) for r in lookup.empty_filter_hints(df, "t", "A-7").collect()] == [("007", "part", 1)]
    assert lookup.find_value({"d": df}, "ALPHA").collect()[0]["partial"] == 2
    with pytest.raises(ValueError):
        lookup.find_value({"d": df.select("k")}, "x")
    resolved = {r["t"]: r["t_key"] for r in lookup.resolve_keys(df.select("t"), "t", df, "k", "t").collect()}
    assert resolved == {"Alpha": 1, "007": 2, None: None, "alphabet": 4}
    assert lookup.resolve_contained(df.select("t"), "t", spark.createDataFrame([(1, "alpha"), (4, "alphabet")], "key int, name string")).where("t = 'alphabet'").first()["t_key"] == "4"
    assert lookup.mentioned_values(df.limit(0), "t", df.select(F.col("k").alias("doc_id"), F.col("t").alias("text"))).count() == 0
    assert lookup.semantic_type("o_custkey", "bigint", 0.1) == "measure" and lookup.semantic_type("note", "string", 0.95) == "free_text"


def test_many_values_are_all_looked_for(spark):
    names = [f"Name {i:04d}" for i in range(900)] + [f"{i}" for i in range(10**5, 10**5 + 700)] + ["abc", None, "x" * 51, "ÄRGER (a)", "name 0007"]
    texts = [f"of nAme {i * 3:04d} and name {i:04d}, NAME {i:04d}; ärger (a)" for i in range(400)] + [None, "", "100001", "Name"]
    result = spark.createDataFrame([(n,) for n in names * 2], "v string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {n: k for n in names[:900] + names[-2:] if (k := sum(n.lower() in (t or "").lower() for t in texts))}
    assert len(want) > 500
    assert {r["value"]: r["documents"] for r in lookup.mentioned_values(result, "v", docs).collect()} == want
    few = result.where("v like 'Name 00%' or v like '10%'")  # 700 numbers are no values, so 100 are left
    assert {r["value"]: r["documents"] for r in lookup.mentioned_values(few, "v", docs).collect()} == {n: k for n, k in want.items() if n.startswith("Name 00")}


def test_memory(spark):
    facts = spark.createDataFrame([("n", "s", "old", 1), ("n", "s", "old", 2), ("n", "s", "new", 3)], "node string, subject string, fact string, at int")
    assert {r["fact"]: (r["confidence"], r["superseded"]) for r in memory.upsert_facts(facts).collect()} == {"old": (2, True), "new": (1, False)}
    assert memory.fingerprint({"b": ["y", "x"], "a": []}) == memory.fingerprint({"a": [], "b": ["x", "y"]})
    a = memory.approach_of("SELECT name, sum(x) FROM t JOIN u ON t.id = u.id WHERE x > 1 GROUP BY name")
    assert a.tables == {"t", "u"} and a.joins == {"t.id = u.id"} and a.aggregates == {"sum"} and a.grain == {"name"}
    assert memory.similarity(a, a) == 1.0 and memory.similarity(memory.Approach(), memory.Approach()) == 0.0


def test_chunks_and_samples(spark):
    docs = spark.createDataFrame([(1, "aaaa\n\nbbbb\n\ncccc"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r["chunk"], r["chars"], r["parts"]) for r in documents.chunks(docs, 8, 15).where("doc_id = 1").collect()] == [(0, 8, 2), (1, 4, 1)]
    assert documents.chunks(docs, 100, 1).where("doc_id = 1").count() == 3
    parts = spark.createDataFrame([(i, "x" * (i * 7 % 50 + 1)) for i in range(100)], "k long, t string")
    sample = {r["t"] for r in documents.stratified_sample(parts, "t", "k").collect()}
    assert {"x", "x" * 50} <= sample and len(sample) < 12
    assert documents.stratified_sample(parts.limit(0), "t", "k").count() == 0


def test_values_and_dates(spark):
    df = spark.createDataFrame([("red",), ("red",), ("dark red",), ("redder",), (None,)], "c string")
    assert {r["value"]: r["canonical"] for r in documents.canonical_values(df, "c").collect()} == {"dark red": "red"}
    dates = spark.createDataFrame([("March 5, 2004",), ("July 2003",), ("soon",), ("2001-02-03",)], "d string")
    assert [r["d"] for r in documents.normalise_date_column(dates, "d").collect()] == ["2004-03-05", "2003-07-01", "soon", "2001-02-03"]
    few = dates.limit(1)
    assert documents.normalise_date_column(few, "d").first()["d"] == "March 5, 2004"


def test_commas_in_strings_stay():
    from tamarack.functions.json_repair import repair_json

    assert repair_json('{"a": ", ]", "b": [1, 2, ], }') == '{"a": ", ]", "b": [1, 2]}'
    assert repair_json('so: {"k": "v,}", "open": [1, {"x": "cut') == '{"k": "v,}", "open": [1, {"x": "cut"}]}'
    assert repair_json(None) is None and repair_json("") is None and repair_json("no json") is None
