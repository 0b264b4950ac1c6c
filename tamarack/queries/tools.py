"""Queries of lookup, rules, guards, memory and further document operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.json_repair import repaired
from tamarack.operators import documents as D
from tamarack.operators import graph, guards, lookup, memory, merge, rules
from tamarack.operators.rules import FilterTerm
from tamarack.queries import core
from tamarack.session import load

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query(
    "find_value",
    "SELECT * FROM (SELECT 'part' AS table_name, 'p_type' AS column_name, count(*) FILTER (lower(p_type) = 'steel') AS exact, count(*) FILTER (contains(lower(p_type), 'steel')) AS partial FROM part UNION ALL SELECT 'part', 'p_name', count(*) FILTER (lower(p_name) = 'steel'), count(*) FILTER (contains(lower(p_name), 'steel')) FROM part UNION ALL SELECT 'part', 'p_brand', count(*) FILTER (lower(p_brand) = 'steel'), count(*) FILTER (contains(lower(p_brand), 'steel')) FROM part UNION ALL SELECT 'region', 'r_name', count(*) FILTER (lower(r_name) = 'steel'), count(*) FILTER (contains(lower(r_name), 'steel')) FROM region) WHERE partial > 0",
)
def _(spark, d):
    return lookup.find_value({t: load(spark, d, t) for t in ("part", "region")}, "Steel")


_MAPPED = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (lower({c}) = 'building') AS e, count(*) FILTER (contains(lower({c}), 'building')) AS p FROM {t}" for t, c in (("customer", "c_name"), ("customer", "c_mktsegment"), ("region", "r_name")))


@query("map_value", f"SELECT table_name, column_name, CASE WHEN e > 0 THEN 'exact' ELSE 'like' END AS method, CASE WHEN e > 0 THEN e ELSE p END AS n FROM ({_MAPPED}) WHERE p > 0")
def _(spark, d):
    return lookup.map_value({t: load(spark, d, t) for t in ("customer", "region")}, "building")


@query("empty_filter_hints", "SELECT c_mktsegment AS candidate, 'case' AS reason, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' AND c_mktsegment <> 'building' GROUP BY 1 UNION ALL SELECT c_mktsegment, 'prefix', count(*) FROM customer WHERE starts_with(lower(c_mktsegment), 'buil') AND lower(c_mktsegment) <> 'building' GROUP BY 1")
def _(spark, d):
    return lookup.empty_filter_hints(load(spark, d, "customer"), "c_mktsegment", "building")


@query(
    "sample_column_comparison",
    "SELECT 'left' AS side, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT id v FROM patient WHERE trim(id) <> '' ORDER BY 1 LIMIT 8)) AS samples, round(avg(CASE WHEN id IS NULL OR trim(id) = '' THEN 1.0 ELSE 0.0 END), 6) AS empty_share FROM patient UNION ALL SELECT 'right', (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT id v FROM laboratory WHERE trim(id) <> '' ORDER BY 1 LIMIT 8)), round(avg(CASE WHEN id IS NULL OR trim(id) = '' THEN 1.0 ELSE 0.0 END), 6) FROM laboratory",
)
def _(spark, d):
    return lookup.compare_columns(load(spark, d, "patient"), load(spark, d, "laboratory"), "id")


@query("resolve_names_to_keys", "SELECT s_suppkey, n_nationkey AS nation_key FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    n = load(spark, d, "nation")
    named = load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower("n_name").alias("nation"))
    return lookup.resolve_keys(named, "nation", n, "n_nationkey", "n_name").select("s_suppkey", "nation_key")


@query("resolve_contained_names", "SELECT c_custkey, CAST(r_regionkey AS VARCHAR) AS note_key FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    r = load(spark, d, "region")
    names = r.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    noted = c.select("c_custkey", F.concat(F.lit("lives in "), F.col("r_name"), F.lit(" now")).alias("note"))
    return lookup.resolve_contained(noted, "note", names).select("c_custkey", "note_key")


@query("ambiguous_columns", "SELECT 'id' AS column_name, 'laboratory,patient' AS tables, 2 AS n UNION ALL SELECT 'loaded_at', 'laboratory,patient', 2")
def _(spark, d):
    return lookup.ambiguous_columns(graph.column_table(spark, {t: load(spark, d, t) for t in ("patient", "laboratory", "nation")}))


_LINKS = ", ".join(f"('{a}', '{c}')" for a, _, c, _ in core._EDGES)


@query(
    "ambiguous_joins",
    f"""WITH e(a, b) AS (SELECT * FROM (VALUES {_LINKS}) v(a, b) UNION ALL SELECT b, a FROM (VALUES {_LINKS}) v(a, b)),
    w AS (SELECT a, b, count(*) n FROM e WHERE a < b GROUP BY a, b UNION ALL SELECT x.a, y.b, count(*) FROM e x JOIN e y ON x.b = y.a WHERE x.a < y.b GROUP BY 1, 2)
    SELECT a AS left_table, b AS right_table, CAST(sum(n) AS BIGINT) AS ways FROM w GROUP BY a, b HAVING sum(n) > 1""",
)
def _(spark, d):
    edges = spark.createDataFrame(core._EDGES, "source_table string, source_column string, target_table string, target_column string")
    return lookup.ambiguous_joins(edges)


@query("doc_mentions_values", "SELECT lower(v) AS value, count(*) AS documents FROM (VALUES ('thrombosis'), ('budget'), ('molecule')) t(v) JOIN documents ON contains(lower(text), v) GROUP BY 1")
def _(spark, d):
    values = spark.createDataFrame([("thrombosis",), ("budget",), ("molecule",), ("x",), ("12345.6",)], "v string")
    return lookup.mentioned_values(values, "v", load(spark, d, "documents"))


@query("doc_mentions_ids", r"SELECT v AS value, count(*) AS documents FROM (SELECT DISTINCT source_id AS v FROM relationships WHERE length(source_id) BETWEEN 5 AND 50 AND NOT regexp_full_match(source_id, '[-\d.,\s]+')) JOIN documents ON contains(lower(text), lower(v)) GROUP BY 1")
def _(spark, d):
    return lookup.mentioned_values(load(spark, d, "relationships"), "source_id", load(spark, d, "documents"))


_WORDS = ("thrombosis", "the", "patient", "and", "antibody", "titre")
_HITS = " + ".join(f"CAST(contains(lower(p), '{w}') AS INTEGER)" for w in _WORDS)
_PARAGRAPHS = rf"(SELECT doc_id, k - 1 AS place, {_HITS} AS hits FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS p, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) AS k FROM documents WHERE text IS NOT NULL))"


@query("knowledge_paragraphs", f"SELECT doc_id, place, hits FROM {_PARAGRAPHS} WHERE hits > 0 ORDER BY hits DESC, doc_id, place LIMIT 5")
def _(spark, d):
    return lookup.paragraphs_for(load(spark, d, "documents").where("text is not null"), "thrombosis of the patient and the antibody titre")


@query("best_paragraphs", f"SELECT doc_id, arg_max(place, (hits, -place)) AS place, max(hits) AS hits FROM {_PARAGRAPHS} WHERE hits > 0 GROUP BY doc_id")
def _(spark, d):
    return lookup.best_paragraph_per_document(load(spark, d, "documents").where("text is not null"), "thrombosis of the patient and the antibody titre")


@query("alias_candidates", "SELECT 'event_status' AS column_name, count(DISTINCT event_status) AS distinct_values FROM club_event HAVING count(DISTINCT event_status) BETWEEN 2 AND 50 UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM club_event HAVING count(DISTINCT event_type) BETWEEN 2 AND 50")
def _(spark, d):
    return lookup.alias_candidates(load(spark, d, "club_event").select("event_status", "event_type", "event_id"))


@query("semantic_types", "SELECT * FROM (VALUES ('o_orderdate', 'timestamp'), ('o_orderpriority', 'category'), ('o_totalprice', 'measure'), ('event_id', 'identifier')) t(column_name, semantic_type)")
def _(spark, d):
    columns = [("o_orderdate", "timestamp_ntz", 0.2), ("o_orderpriority", "string", 0.001), ("o_totalprice", "double", 0.9), ("event_id", "bigint", 1.0)]
    return spark.createDataFrame([(c, lookup.semantic_type(c, k, r)) for c, k, r in columns], "column_name string, semantic_type string")


def _proposals(spark, found: list) -> DataFrame:
    rows = [(p.rule, ",".join(f"{t.column} {t.op}" for t in p.original), ",".join(f"{t.column} {t.op}" for t in p.repaired)) for p in found]
    return spark.createDataFrame(rows, "rule string, original string, repaired string")


@query("rule_impossible_threshold", "SELECT 'impossible_threshold' AS rule, 'l_quantity >,l_quantity <' AS original, 'l_quantity IS NOT NULL' AS repaired WHERE (SELECT count(*) FROM lineitem WHERE l_quantity > 100000) = 0 AND (SELECT count(*) FROM lineitem WHERE l_quantity < -1) = 0")
def _(spark, d):
    return _proposals(spark, rules.impossible_threshold(load(spark, d, "lineitem"), [FilterTerm("l_quantity", ">", 100000), FilterTerm("l_quantity", "<", -1)]))


@query("rule_coverage", "SELECT 'coverage' AS rule, 'glu >' AS original, 'glu IS NOT NULL' AS repaired WHERE (SELECT count(*) FILTER (glu > -1000) = count(glu) FROM laboratory WHERE NOT isnan(glu) OR glu IS NULL)")
def _(spark, d):
    return _proposals(spark, rules.coverage_simplification(load(spark, d, "laboratory"), [FilterTerm("glu", ">", -1000)]))


@query("rule_plausibility", "SELECT 'plausibility' AS rule, 'o_totalprice >,o_orderstatus =' AS original, 'o_orderstatus =' AS repaired WHERE (SELECT count(*) FROM orders WHERE o_totalprice > 100000000 AND o_orderstatus = 'F') = 0 AND (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 0")
def _(spark, d):
    found = rules.plausibility(load(spark, d, "orders"), "o_custkey", [FilterTerm("o_totalprice", ">", 100000000), FilterTerm("o_orderstatus", "=", "F")])
    return _proposals(spark, [found] if found else [])


@query("rule_temporal_format", "SELECT 'temporal_format' AS rule, 'day =' AS original, 'day LIKE' AS repaired WHERE (SELECT count(*) FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') LIKE '1995-03%') > 0")
def _(spark, d):
    o = load(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))
    found = rules.temporal_format(o, FilterTerm("day", "=", "1995-03"))
    return _proposals(spark, [found] if found else [])


@query("rule_existence", "SELECT 'existence' AS rule, 'deleted =' AS original, 'deleted IS NOT NULL' AS repaired WHERE (SELECT count(deleted_at) / count(*) < 0.3 FROM patient)")
def _(spark, d):
    p = load(spark, d, "patient").select(F.col("deleted_at").cast("string").alias("deleted"))
    found = rules.existence(p, FilterTerm("deleted", "=", "1999-01-01"))
    return _proposals(spark, [found] if found else [])


@query(
    "rule_cross_row",
    "WITH c AS (SELECT o_custkey, max(CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'F' THEN 1 ELSE 0 END) s, max(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) a, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) b, count(*) n FROM orders GROUP BY 1) SELECT 'cross_row' AS rule, 'o_totalprice >,o_orderstatus =' AS original, 'o_totalprice >,o_orderstatus =' AS repaired FROM c HAVING avg(n) > 1.5 AND sum(s) <> sum(CASE WHEN a = 1 AND b = 1 THEN 1 ELSE 0 END)",
)
def _(spark, d):
    found = rules.cross_row(load(spark, d, "orders"), "o_custkey", [FilterTerm("o_totalprice", ">", 300000), FilterTerm("o_orderstatus", "=", "F")])
    return _proposals(spark, [found] if found else [])


@query("rule_normal_range", "SELECT column_name, op, CAST(bound AS DOUBLE) AS bound, (SELECT count(*) FILTER (glu BETWEEN 70 AND 110) FROM laboratory) AS inside FROM (VALUES ('glu', '>=', 70), ('glu', '<=', 110)) t(column_name, op, bound)")
def _(spark, d):
    lab = load(spark, d, "laboratory")
    found = rules.normal_range(lab, "glu", True, "A normal GLU lies between 70 and 110.")
    inside = lab.where(rules.all_of([t.condition() for t in found.repaired])).count()
    return spark.createDataFrame([(t.column, t.op, float(t.value), inside) for t in found.repaired], "column_name string, op string, bound double, inside bigint")


# Without knowledge the range comes from the distribution; abnormal keeps the sides that have rows.
@query("rule_abnormal_range", f"WITH {core._FENCES}, c AS (SELECT count(*) FILTER (glu < lo) AS b, count(*) FILTER (glu > hi) AS a FROM laboratory, f) SELECT '<' AS op, lo AS bound, b AS n FROM f, c WHERE b > 0 UNION ALL SELECT '>', hi, a FROM f, c WHERE a > 0")
def _(spark, d):
    lab = load(spark, d, "laboratory")
    found = rules.normal_range(lab, "glu", False)
    return spark.createDataFrame([(t.op, float(t.value), lab.where(t.condition()).count()) for t in (found.repaired if found else ())], "op string, bound double, n bigint")


@query("guard_chain", "SELECT 'repeated' AS answer, 'duplicates' AS guard WHERE (SELECT count(*) - count(DISTINCT n_regionkey) FROM nation) > 0 UNION ALL SELECT 'long', 'row_cap' WHERE (SELECT count(*) FROM customer) > 500 UNION ALL SELECT 'crossed', 'cross_join' UNION ALL SELECT 'empty', 'null_ratio' FROM (SELECT count(*) n, avg(CASE WHEN deleted_at IS NULL THEN 1.0 ELSE 0 END) r FROM (SELECT DISTINCT id, deleted_at FROM patient WHERE birthday >= DATE '2004-01-01')) WHERE n > 5 AND n <= 500 AND r > 0.8")
def _(spark, d):
    n = load(spark, d, "nation")
    p = load(spark, d, "patient").where("birthday >= date'2004-01-01'").select("id", "deleted_at").distinct()
    answers = {"repeated": n.select("n_regionkey"), "sound": n.select("n_name"), "long": load(spark, d, "customer").select("c_custkey"), "crossed": n.select("n_name").crossJoin(load(spark, d, "region").select("r_name")), "empty": p}
    return spark.createDataFrame([(a, o.guard) for a, df in answers.items() for o in guards.check(df)], "answer string, guard string")


@query("guard_empty_order", "SELECT count(*) FILTER (first_date IS NULL) > 0 AS objected FROM patient")
def _(spark, d):
    found = guards.empty_first(load(spark, d, "patient"), "first_date")
    return spark.createDataFrame([(found is not None,)], "objected boolean")


@query(
    "fact_upsert",
    "WITH f AS (SELECT action AS node, task_id AS subject, run_id AS fact, step_id AS w FROM step_record WHERE action IS NOT NULL AND task_id IS NOT NULL AND run_id IS NOT NULL), k AS (SELECT node, subject, fact, count(*) AS confidence, max(w) AS w FROM f GROUP BY ALL) SELECT node, subject, fact, confidence, w < max(w) OVER (PARTITION BY node, subject) AS superseded FROM k",
)
def _(spark, d):
    s = load(spark, d, "step_record").where("action is not null and task_id is not null and run_id is not null")
    return memory.upsert_facts(s.select(F.col("action").alias("node"), F.col("task_id").alias("subject"), F.col("run_id").alias("fact"), F.col("step_id").alias("at")))


@query("approach_similarity", "SELECT 'same' AS name, 1.0 AS similarity UNION ALL SELECT 'near', round((2.0 + 1.5 * 0.5 + 1.0 + 1.0) / 5.5, 6)")
def _(spark, d):
    a = memory.approach_of("SELECT count(*) FROM orders WHERE o_totalprice > 1 AND o_orderstatus = 'F'")
    others = {"same": a, "near": memory.approach_of("SELECT count(*) FROM orders WHERE o_totalprice > 1"), "far": memory.approach_of("SELECT x FROM part")}
    return spark.createDataFrame([(n, s) for s, n in memory.similar(others, a)], "name string, similarity double")


@query(
    "json_repaired",
    "SELECT count(*) AS replies FROM step_record WHERE json_valid(raw_response) AND trim(raw_response) LIKE '{%'",
)
def _(spark, d):
    s = load(spark, d, "step_record").where("trim(raw_response) like '{%}'")
    whole = s.withColumn("j", repaired(F.col("raw_response"))).where(F.col("j").isNotNull() & F.try_parse_json("raw_response").isNotNull())
    return whole.agg(F.count("*").alias("replies"))


@query("json_replies")
def _(spark, d):
    return load(spark, d, "step_record").select("step_id", repaired(F.col("raw_response")).alias("reply"))


def _split_sql(separator: str, least: int) -> str:
    cut = f"regexp_split_to_array(text, '{separator}')"
    return f"SELECT doc_id, k, length(trim(v)) AS size FROM (SELECT doc_id, unnest({cut}) AS v, generate_subscripts({cut}, 1) AS k FROM documents WHERE text IS NOT NULL) WHERE length(trim(v)) >= {least}"


# Replies whose JSON stands in a fence: what is repaired is what the fence holds.
@query("json_fenced", r"WITH f AS (SELECT step_id, regexp_extract(raw_response, '(?s)```(?:json)?\s*(.*?)```', 1) AS j FROM step_record WHERE contains(raw_response, '```')) SELECT step_id, json_extract_string(j, '$.action') AS action, len(json_keys(j)) AS keys FROM f WHERE json_valid(j) AND starts_with(trim(j), '{')")
def _(spark, d):
    fence = F.regexp_extract("raw_response", r"(?s)```(?:json)?\s*(.*?)```", 1)
    s = load(spark, d, "step_record").where(F.contains("raw_response", F.lit("```"))).withColumn("j", fence)
    whole = s.where(F.startswith(F.trim("j"), F.lit("{")) & F.try_parse_json("j").isNotNull()).withColumn("reply", repaired(F.col("raw_response")))
    return whole.select("step_id", F.get_json_object("reply", "$.action").alias("action"), F.size(F.json_object_keys("reply")).alias("keys"))


@query("doc_chunks", core.packed_sql(_split_sql(r"\n\s*\n", 1), 4000, 15, "chars", "chunk"))
def _(spark, d):
    return D.chunks(load(spark, d, "documents").where("text is not null"), 4000, 15)


# The shortest and longest document, the one at the middle of the lengths, and five evenly spaced ids; of equal lengths the smallest id.
@query(
    "doc_sample",
    """WITH t AS (SELECT doc_id, length(text) AS len FROM documents WHERE text IS NOT NULL), k AS (SELECT len, count(*) AS n, min(doc_id) AS f FROM t GROUP BY len), c AS (SELECT *, sum(n) OVER (ORDER BY len) AS upto, sum(n) OVER () AS total FROM k),
    s AS (SELECT min(doc_id) AS lo, greatest(1, (max(doc_id) - min(doc_id) + 1) // 5) AS step FROM t),
    w AS (SELECT arg_min(f, len) AS id FROM k UNION SELECT arg_max(f, len) FROM k UNION SELECT arg_min(f, len) FROM c WHERE 2 * upto >= total UNION SELECT lo + i * step FROM s, range(5) r(i)) SELECT doc_id FROM t WHERE doc_id IN (SELECT id FROM w)""",
)
def _(spark, d):
    return D.stratified_sample(load(spark, d, "documents").where("text is not null").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query("doc_composite_ids", r"SELECT id, count(DISTINCT doc_id) AS parts FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:[0-9]{5,}|rec[A-Za-z0-9]{8,})\b')) AS id FROM documents WHERE text IS NOT NULL) GROUP BY id HAVING count(DISTINCT doc_id) >= 3")
def _(spark, d):
    return D.composite_key(load(spark, d, "documents"))


@query("known_value_mentions", "SELECT o_orderkey AS k, o_orderpriority AS value FROM orders")
def _(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("1-URGENT? no: "), F.col("o_orderpriority"), F.lit(", yes, "), F.col("o_orderpriority")).alias("t"))
    return o.select("k", D.known_value(F.col("t"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).alias("value"))


@query("canonical_categories", "SELECT lower(c_mktsegment) || ' segment' AS value, lower(c_mktsegment) AS canonical FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    c = load(spark, d, "customer").select("c_mktsegment")
    both = c.unionByName(c.select(F.concat("c_mktsegment", F.lit(" segment")).alias("c_mktsegment")).distinct())
    return D.canonical_values(both, "c_mktsegment")


@query("normalised_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMMM d, yyyy").alias("day"))
    return D.normalise_date_column(o, "day")


@query("flagged_values", "SELECT CASE step_id % 4 WHEN 0 THEN 'no_value_found' WHEN 1 THEN 'unclear_association' WHEN 2 THEN 'multiple_values' ELSE 'none' END AS flag, count(*) AS n FROM step_record GROUP BY 1")
def _(spark, d):
    m = F.col("step_id") % 4
    v = load(spark, d, "step_record").select(F.when(m > 0, "v").alias("value"), F.when(m == 1, "low").otherwise("high").alias("confidence"), F.lit(False).alias("is_correction"), F.when(m == 2, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("alternatives"))
    return merge.flag_values(v).groupBy(F.coalesce("flag", F.lit("none")).alias("flag")).agg(F.count("*").alias("n"))


@query("normalised_ids", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id FROM customer")
def _(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("Customer "), F.col("c_custkey")).alias("id"))
    return merge.normalise_ids(c, "id")
