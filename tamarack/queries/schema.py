"""Queries of the schema graph, plan inspection, guards, rules and hypotheses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators import graph, guards, knowledge, lookup, memory, merge, probes, profile, rules, scoring
from tamarack.operators.rules import FilterTerm
from tamarack.plans import inspect, planner
from tamarack.queries import core
from tamarack.session import load, work_folder

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rows(spark, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


# --- the graph ------------------------------------------------------------------

_SMALL = ("region", "nation", "customer", "supplier")
_SMALL_COLUMNS = {"region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal"}
_SMALL_EDGES = [e for e in core._EDGES if e[0] in _SMALL and e[2] in _SMALL]


def small_graph(spark, d: str) -> knowledge.SchemaGraph:
    return knowledge.build_graph(spark, {t: load(spark, d, t) for t in _SMALL})


@query("graph_columns", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {k} AS place, count(*) AS total, count(DISTINCT {c}) AS distinct_count FROM {t}" for t, cs in _SMALL_COLUMNS.items() for k, c in enumerate(cs.split())))
def _(spark, d):
    return small_graph(spark, d).columns.select("table_name", "column_name", "place", "total", "distinct_count")


@query("graph_find_value", "SELECT 'customer' AS table_name, 'c_mktsegment' AS column_name, c_mktsegment AS value, lower(c_mktsegment) = 'build' AS exact FROM customer WHERE contains(lower(c_mktsegment), 'build') GROUP BY c_mktsegment HAVING (SELECT count(DISTINCT c_mktsegment) FROM customer) <= 500")
def _(spark, d):
    return small_graph(spark, d).find_value("Build").where("table_name = 'customer' and column_name = 'c_mktsegment'")


@query("graph_column_values", "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    return small_graph(spark, d).column_values("customer", "c_mktsegment")


_EDGE_ROWS = ", ".join(f"('{a}', '{k}', '{b}', '{r}')" for a, k, b, r in _SMALL_EDGES)


@query("graph_between", f"SELECT * FROM (VALUES {_EDGE_ROWS}) e(source_table, source_column, target_table, target_column) WHERE 'nation' IN (source_table, target_table) AND 'supplier' IN (source_table, target_table)")
def _(spark, d):
    return small_graph(spark, d).between("nation", "supplier").select("source_table", "source_column", "target_table", "target_column")


@query("graph_neighbours", f"WITH e(a, k, b, r) AS (VALUES {_EDGE_ROWS}) SELECT b AS neighbour, 'refers_to' AS way FROM e WHERE a = 'nation' UNION SELECT a, 'referred_by' FROM e WHERE b = 'nation'")
def _(spark, d):
    return small_graph(spark, d).neighbours("nation").where("way <> 'similar'")


@query("graph_relationships", " UNION ALL ".join(f"SELECT '{a}.{k} -> {b}.{r} (' || CASE WHEN count(DISTINCT {k}) >= count({k}) THEN 'one' ELSE 'many' END || '-to-one, ' || printf('%.2f', count(DISTINCT {k}) FILTER ({k} IN (SELECT {r} FROM {b})) / count(DISTINCT {k})) || ')' AS line FROM {a}" for a, k, b, r in _SMALL_EDGES))
def _(spark, d):
    return small_graph(spark, d).relationships()


_KINDS = {"regionkey": "int", "nationkey": "int", "custkey": "bigint", "suppkey": "bigint", "acctbal": "double"}
_TEXT_OF = lambda t: " || ', ' || ".join(f"'{c} {_KINDS.get(c[2:], 'string')} ' || printf('%.3f', (SELECT 1 - ((count(*) - count({c})) * 2000 + count(*)) // (2 * count(*)) / 1000.0 FROM {t}))" for c in _SMALL_COLUMNS[t].split())


@query("graph_text", " UNION ALL ".join(f"SELECT '{t}' AS table_name, {_TEXT_OF(t)} AS text" for t in _SMALL))
def _(spark, d):
    return small_graph(spark, d).tables_text()


@query("graph_overview", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, {len(_SMALL_COLUMNS[t].split())} AS columns, {len({b for a, _, b, _ in _SMALL_EDGES if a == t})} AS refers_to, {len({a for a, _, b, _ in _SMALL_EDGES if b == t})} AS referred_by FROM {t}" for t in _SMALL))
def _(spark, d):
    return small_graph(spark, d).overview()


@query("graph_relevant_columns", "SELECT 'customer' AS table_name, 'c_acctbal' AS column_name UNION ALL SELECT 'supplier', 's_acctbal' UNION ALL SELECT 'customer', 'c_mktsegment'")
def _(spark, d):
    return small_graph(spark, d).relevant_columns("acctbal by segment")


@query("graph_ontology", "SELECT * FROM (VALUES ('region', 'r_name', true), ('nation', 'n_name', true), ('customer', 'c_name', (SELECT count(DISTINCT c_name) > 0.8 * count(*) FROM customer)), ('customer', 'c_mktsegment', (SELECT count(DISTINCT c_mktsegment) > 0.8 * count(*) FROM customer)), ('supplier', 's_name', (SELECT count(DISTINCT s_name) > 0.8 * count(*) FROM supplier))) t(table_name, column_name, free)")
def _(spark, d):
    return small_graph(spark, d).ontology().where("semantic_type in ('free_text', 'category')").select("table_name", "column_name", (F.col("semantic_type") == "free_text").alias("free"))


@query("graph_resolve", "SELECT 'member' AS how, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) UNION ALL SELECT 'alias', 'MACHINERY' UNION ALL SELECT DISTINCT 'value', c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'furniture'")
def _(spark, d):
    g = small_graph(spark, d)
    members = graph.members(load(spark, d, "region"), "r_regionkey", "r_name", load(spark, d, "nation"), "n_regionkey", "n_name")
    first = load(spark, d, "region").agg(F.min("r_name")).first()[0]
    found = [g.resolve(t, {"engines": "MACHINERY"}, members) for t in (first.lower(), "Engines", "furniture")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("how", "value")


@query("graph_extended", f"SELECT * FROM (VALUES {_EDGE_ROWS}) e(source_table, source_column, target_table, target_column)")
def _(spark, d):
    """The edges after customer and supplier arrived in a graph of region and nation: those of the whole."""
    first = {t: load(spark, d, t) for t in ("region", "nation")}
    g = knowledge.extend_graph(spark, knowledge.build_graph(spark, first), first, {t: load(spark, d, t) for t in ("customer", "supplier")})
    return g.keys.select("source_table", "source_column", "target_table", "target_column")


@query("graph_schema_samples", "SELECT 'nation' AS table_name, 'n_name' AS column_name, 'string' AS type, (SELECT count(*) FROM nation) AS row_count, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT n_name v FROM nation ORDER BY 1 LIMIT 5)) AS samples, false AS shared UNION ALL SELECT 'patient', 'loaded_at', 'timestamp_ntz', (SELECT count(*) FROM patient), NULL, true")
def _(spark, d):
    s = knowledge.consolidated_schema({t: load(spark, d, t) for t in ("nation", "patient", "laboratory")})
    wanted = s.where("(table_name = 'nation' and column_name = 'n_name') or (table_name = 'patient' and column_name = 'loaded_at')")
    return wanted.withColumn("samples", F.when(F.col("column_name") == "n_name", F.col("samples")))


@query("graph_collisions", "SELECT 'loaded_at' AS column_name, 'laboratory,patient' AS tables, 2 AS n")
def _(spark, d):
    columns = graph.column_table(spark, {t: load(spark, d, t) for t in ("patient", "laboratory", "nation")})
    return knowledge.column_collisions(columns, "When was it loaded?")


@query("graph_sql_ambiguity", "SELECT 'loaded_at' AS column_name")
def _(spark, d):
    for t in ("patient", "laboratory"):
        load(spark, d, t).createOrReplaceTempView(f"tamarack_{t}")
    found = knowledge.ambiguous_references(spark, "SELECT loaded_at FROM tamarack_patient p JOIN tamarack_laboratory l ON p.id = l.id")
    return rows(spark, [(f,) for f in found], "column_name string")


@query("graph_grounding", "SELECT * FROM (VALUES ('no column nation.n_color'), ('no rows'), ('no table planet')) t(fault)")
def _(spark, d):
    tables = {t: load(spark, d, t) for t in ("nation", "region")}
    tables["nation"].createOrReplaceTempView("tamarack_nation")
    plan = {"tables": ["nation", "planet"], "columns": ["nation.n_name", "nation.n_color"], "sql": "SELECT * FROM tamarack_nation WHERE n_nationkey < 0"}
    return rows(spark, [(f,) for f in knowledge.grounding_faults(spark, plan, tables)], "fault string")


@query("label_columns", "SELECT * FROM (VALUES ('region', 'r_name'), ('nation', 'n_name'), ('customer', 'c_name'), ('supplier', 's_name')) t(table_name, label)")
def _(spark, d):
    return rows(spark, [(t, graph.label_column(load(spark, d, t))) for t in _SMALL], "table_name string, label string")


@query("doc_business_topology", "SELECT r_name AS parent, count(DISTINCT n_name) AS children FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def _(spark, d):
    m = graph.members(load(spark, d, "region"), "r_regionkey", "r_name", load(spark, d, "nation"), "n_regionkey", "n_name")
    return m.groupBy("parent").agg(F.count("*").alias("children"))


# --- matching names -------------------------------------------------------------

_TERMS = ("glucose", "weights", "loaded")
_PREFIX = "coalesce(list_max(list_filter(range(1, least(length(c), length(t)) + 1), lambda x: left(c, x) = left(t, x))), 0)"


@query("term_matches", f"SELECT DISTINCT col_name FROM (SELECT col_name, lower(col_name) AS c FROM column_info WHERE col_name IS NOT NULL), (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in _TERMS)}) v(t) WHERE contains(c, t) OR contains(t, c) OR ({_PREFIX} >= 3 AND {_PREFIX} >= 0.6 * least(length(c), length(t)))")
def _(spark, d):
    names = [r[0] for r in load(spark, d, "column_info").where("col_name is not null").select("col_name").distinct().collect()]
    return rows(spark, [(n,) for n in names if lookup.term_matches(n, list(_TERMS))], "col_name string")


@query("token_overlaps", "SELECT col_id, round(len(list_intersect(w, ['total', 'bilirubin', 'of', 'blood'])) / least(len(w), 4), 6) AS overlap FROM (SELECT col_id, list_distinct(list_filter(regexp_split_to_array(lower(description), '\\s+'), lambda x: x <> '')) AS w FROM column_info WHERE trim(description) <> '')")
def _(spark, d):
    info = load(spark, d, "column_info").where("trim(description) <> ''").select("col_id", "description").collect()
    return rows(spark, [(r["col_id"], round(lookup.token_overlap(r["description"], "total bilirubin of blood"), 6)) for r in info], "col_id bigint, overlap double")


_PHRASE_COLUMNS = [planner.ColumnFacts("orders", "o_totalprice", "double", "price of the whole order", (), 1000), planner.ColumnFacts("orders", "o_orderdate", "timestamp_ntz", "date of the order", (), 500), planner.ColumnFacts("customer", "c_mktsegment", "string", "market segment", ("BUILDING", "MACHINERY"), 5), planner.ColumnFacts("part", "p_retailprice", "double", "retail price", (), 50)]


# total price: o_totalprice has all letters (10), two words of it none more, description price (1.5), text type none, distinct 2; p_retailprice one word of two begins alike? none; description 1.5, distinct 1.
@query("phrase_columns", "SELECT * FROM (VALUES (13.5, 'orders', 'o_totalprice'), (2.5, 'part', 'p_retailprice'), (2.0, 'customer', 'c_mktsegment'), (2.0, 'orders', 'o_orderdate')) t(score, table_name, column_name)")
def _(spark, d):
    return rows(spark, planner.map_phrase("total price", _PHRASE_COLUMNS), "score double, table_name string, column_name string")


@query("phrase_values", "SELECT * FROM (VALUES (18.0, 'customer', 'c_mktsegment')) t(score, table_name, column_name)")
def _(spark, d):
    """A value of the index: 8 for the sample, 8 for the index, 2 for the type."""
    return rows(spark, planner.map_phrase("machinery", _PHRASE_COLUMNS, best=1, values=frozenset({("customer", "c_mktsegment")})), "score double, table_name string, column_name string")


@query("similarity_edges", "SELECT 'lineitem' AS source, 'part' AS target, 0.32 AS weight")
def _(spark, d):
    found = planner.similarity_edges([planner.Edge(*e) for e in core._EDGES if e[2] != "part"], [("lineitem", "part_key", "part", "p_partkey", 0.8), ("customer", "c_nationkey", "nation", "n_nationkey", 1.0), ("orders", "o_comment", "part", "p_comment", 1.0)])
    return rows(spark, [(e.source, e.target, round(e.weight, 6)) for e in found], "source string, target string, weight double")


@query("alternative_paths", core._PATHS.replace("SELECT 'orders', ['orders']", "SELECT 'lineitem', ['lineitem']").replace("p.tip <> 'region'", "p.tip <> 'nation'") + ", r AS (SELECT path, n, row_number() OVER (ORDER BY n, path[2:]) AS p FROM p WHERE tip = 'nation') SELECT array_to_string(path, '>') AS path FROM r WHERE p BETWEEN 2 AND 3")
def _(spark, d):
    found = planner.alternative_paths([planner.Edge(*e) for e in core._EDGES], ["lineitem", "nation"], 4)
    return rows(spark, [(">".join(["lineitem", *(e.target for e in p)]),) for p in found], "path string")


# --- plans and guards -----------------------------------------------------------


def _views(spark, d: str, *names: str) -> None:
    for t in names:
        load(spark, d, t).createOrReplaceTempView(f"tamarack_{t}")


@query("plan_conditions", "SELECT * FROM (VALUES ('where', 2, 'o_orderdate DESC NULLS LAST', 10)) t(kind, conjuncts, sorted_by, rows_kept)")
def _(spark, d):
    _views(spark, d, "orders")
    df = spark.sql("SELECT o_orderkey, o_orderdate FROM tamarack_orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' ORDER BY o_orderdate DESC LIMIT 10")
    order, limit = inspect.order_and_limit(df)
    return rows(spark, [("where", len(inspect.conjuncts(df)), order, limit)], "kind string, conjuncts int, sorted_by string, rows_kept int")


@query("markdown_conditions", "SELECT * FROM (VALUES (0, 'a = 1 AND b = ''x''', 'ORDER BY c LIMIT 3'), (1, 'v > 2', NULL), (2, NULL, 'order by w'), (3, NULL, NULL)) t(line, conditions, tail)")
def _(spark, d):
    lines = ["- use `SELECT a FROM t WHERE a = 1 AND b = 'x' ORDER BY c LIMIT 3` here", "## select v from t where v > 2 group by v", "* select w from t order by w", "no statement"]
    return rows(spark, [(i, inspect.where_of(x), inspect.order_limit_of(x)) for i, x in enumerate(lines)], "line int, conditions string, tail string")


@query("guard_filters", "SELECT 'unverified' AS answer, 'unverified_filter' AS guard UNION ALL SELECT 'vacuous', 'vacuous_filter' WHERE (SELECT count(*) FILTER (l_quantity > 0 AND l_discount > 0.05) = count(*) FILTER (l_discount > 0.05) FROM lineitem)")
def _(spark, d):
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    tested = o.where(F.col("o_orderstatus") == "F")
    answer = o.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000)).select("o_orderkey").limit(5)
    known = o.where(F.col("o_orderstatus") == "F").select("o_orderkey").limit(5)
    conditions = (("quantity", F.col("l_quantity") > 0), ("discount", F.col("l_discount") > 0.05))
    found = [("unverified", guards.check(answer, guards.Context(tested=(tested,)))), ("tested", guards.check(known, guards.Context(tested=(tested,)))), ("vacuous", guards.check(known, guards.Context(source=li, conditions=conditions)))]
    return rows(spark, [(a, o.guard) for a, objections in found for o in objections], "answer string, guard string")


@query("guard_column_resolution", "SELECT 'wrong' AS answer, 'column_resolution' AS guard")
def _(spark, d):
    _views(spark, d, "patient", "laboratory")
    sql = "SELECT {} FROM tamarack_patient p JOIN tamarack_laboratory l ON p.id = l.id LIMIT 1"
    answers = {"wrong": "l.loaded_at", "right": "p.loaded_at", "key": "l.id"}
    resolved = {"loaded_at": "tamarack_patient", "id": "tamarack_patient"}
    found = [(a, guards.wrong_column(spark.sql(sql.format(c)), resolved)) for a, c in answers.items()]
    return rows(spark, [(a, o.guard) for a, o in found if o], "answer string, guard string")


@query("guard_fk_resolution", "SELECT 'ids' AS answer, 'fk_resolution' AS guard")
def _(spark, d):
    e = load(spark, d, "club_event").select(F.col("event_id").alias("link_to_event"), "event_name")
    first = e.where("link_to_event is not null").orderBy("link_to_event").limit(1)
    docs = first.select(F.lit(1).alias("doc_id"), F.concat(F.lit("The event "), "link_to_event", F.lit(" was a meeting.")).alias("text"))
    answers = {"ids": first.select("link_to_event"), "names": first.select("event_name")}
    found = [(a, guards.nameable_ids(df, docs)) for a, df in answers.items()]
    return rows(spark, [(a, o.guard) for a, o in found if o], "answer string, guard string")


@query("guard_unresolved", "SELECT 'wrong' AS answer, 'unresolved_column' AS guard")
def _(spark, d):
    _views(spark, d, "nation")
    found = [("wrong", guards.unresolved_text("SELECT n_color FROM tamarack_nation", spark)), ("right", guards.unresolved_text("SELECT n_name FROM tamarack_nation", spark))]
    return rows(spark, [(a, o.guard) for a, o in found if o], "answer string, guard string")


@query("plan_same_query", "SELECT true AS same, false AS other, true AS crossed, false AS linked")
def _(spark, d):
    _views(spark, d, "nation", "region")
    q = spark.sql
    a, b = q("SELECT n_name FROM tamarack_nation WHERE n_nationkey > 3"), q("select  n_name  from tamarack_nation where n_nationkey > 3")
    crossed, linked = q("SELECT count(*) FROM tamarack_nation, tamarack_region"), q("SELECT count(*) FROM tamarack_nation, tamarack_region WHERE n_regionkey = r_regionkey")
    return rows(spark, [(inspect.same_query(a, b), inspect.same_query(a, q("SELECT n_name FROM tamarack_nation")), inspect.has_cross_join(crossed), inspect.has_cross_join(linked))], "same boolean, other boolean, crossed boolean, linked boolean")


@query("row_caps", "SELECT 'customer' AS answer, (SELECT count(*) > 500 FROM customer) AS objected UNION ALL SELECT 'nation', (SELECT count(*) > 500 FROM nation)")
def _(spark, d):
    return rows(spark, [(t, guards.too_many_rows(load(spark, d, t)) is not None) for t in ("customer", "nation")], "answer string, objected boolean")


@query("zero_row_hints", "SELECT 'elsewhere' AS kind, 'customer.c_mktsegment' AS place, 'BUILDING' AS candidate, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' HAVING count(*) > 0 UNION ALL SELECT 'related', 'nation.n_name', '', 0")
def _(spark, d):
    tables = {t: load(spark, d, t) for t in ("customer", "nation", "region")}
    return lookup.zero_row_hints(tables, "customer", "c_name", "BUILDING", core._EDGES).where("kind <> 'sample'")


# --- probes, rules, hypotheses -----------------------------------------------------


@query("count_entities", "SELECT count(DISTINCT o_custkey) AS entities FROM orders WHERE o_totalprice > 300000")
def _(spark, d):
    return probes.count_entities(load(spark, d, "orders"), "o_custkey", F.col("o_totalprice") > 300000)


@query("null_shares", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS filled, round(1 - count({c}) / count(*), 4) AS null_ratio, 1 - count({c}) / count(*) > 0.7 AS sparse FROM patient" for c in ("id", "sex", "diagnosis", "deleted_at")))
def _(spark, d):
    return profile.null_shares(load(spark, d, "patient").select("id", "sex", "diagnosis", "deleted_at"))


@query("approximate_fences", "SELECT round(avg(glu) - 2.5 * (max(glu) - min(glu)) / 4, 4) AS low, round(avg(glu) + 2.5 * (max(glu) - min(glu)) / 4, 4) AS high, round(min(glu) + (max(glu) - min(glu)) * 0.9, 2) AS top_tenth FROM laboratory")
def _(spark, d):
    low, high, mean = profile.extremes(load(spark, d, "laboratory"), "glu")
    a, b = profile.approximate_fences(low, high, mean)
    return rows(spark, [(round(a, 4), round(b, 4), profile.linear_percentile(low, high, 10))], "low double, high double, top_tenth double")


_PRICE, _STATUS = FilterTerm("o_totalprice", ">", 300000), FilterTerm("o_orderstatus", "=", "F")


@query("rule_ratios", "SELECT 'percentage' AS kind, round(100.0 * count(*) FILTER (o_totalprice > 300000 AND o_orderstatus = 'F') / count(*), 6) AS value FROM orders UNION ALL SELECT 'entities', round(100.0 * count(DISTINCT CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'F' THEN o_custkey END) / count(DISTINCT o_custkey), 6) FROM orders UNION ALL SELECT 'increase', round(count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_totalprice > 300000), 6) FROM orders")
def _(spark, d):
    o = load(spark, d, "orders")
    found = [rules.ratio(o, "o_custkey", [_PRICE, _STATUS], k).select(F.lit(k).alias("kind"), "value") for k in ("percentage", "entities", "increase")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("rule_count_distinct", "SELECT count(*) AS joined, count(DISTINCT c_custkey) AS entities FROM customer JOIN orders ON c_custkey = o_custkey")
def _(spark, d):
    """The join repeats customers, so the rule proposes to count them distinctly."""
    found = rules.count_distinct_rule(["customer", "orders"], "customer", "c_custkey")
    joined = load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.agg(F.count("*").alias("joined"), F.count_distinct(found.repaired[0].column.split(".")[1]).alias("entities"))


@query("rule_plausible", "WITH k AS (SELECT count(DISTINCT CASE WHEN o_totalprice > 100 AND o_orderkey > 0 THEN o_custkey END) AS loose, count(DISTINCT CASE WHEN o_totalprice > 300000 THEN o_custkey END) AS tight, count(DISTINCT o_custkey) AS every FROM orders) SELECT 'loose' AS filter, loose <= 0.8 * every AS plausible, loose AS n FROM k UNION ALL SELECT 'tight', tight > 0, tight FROM k UNION ALL SELECT 'none', false, 0 UNION ALL SELECT 'single', tight <= 5, tight FROM k WHERE tight > 0")
def _(spark, d):
    o = load(spark, d, "orders")
    loose = [FilterTerm("o_totalprice", ">", 100), FilterTerm("o_orderkey", ">", 0)]
    found = {"loose": rules.assess_plausibility(o, "o_custkey", loose), "tight": rules.assess_plausibility(o, "o_custkey", [_PRICE]), "none": rules.assess_plausibility(o, "o_custkey", [FilterTerm("o_totalprice", ">", 1e12)]), "single": rules.assess_plausibility(o, "o_custkey", [_PRICE], "lookup", single=True)}
    return rows(spark, [(k, p.plausible, p.rows) for k, p in found.items()], "filter string, plausible boolean, n bigint")


@query("rule_adapted", "SELECT 'c_mktsegment' AS column_name, 'BUILDING' AS value, count(DISTINCT c_custkey) AS entities FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    """A segment asked for in the name column moves to the column that holds it."""
    tables = {"customer": load(spark, d, "customer")}
    terms, _ = rules.adapt(tables, "customer", "c_custkey", [FilterTerm("c_name", "=", "BUILDING")])
    kept = tables["customer"].where(rules.all_of([t.condition() for t in terms]))
    return kept.agg(F.count_distinct("c_custkey").alias("entities")).select(F.lit(terms[0].column).alias("column_name"), F.lit(terms[0].value).alias("value"), "entities")


@query("rule_repairs", "SELECT 'normal_range' AS rule, 'glu' AS column_name UNION ALL SELECT 'coverage', 'ldh' WHERE (SELECT count(*) FILTER (ldh > -1) = count(ldh) FROM laboratory)")
def _(spark, d):
    found = rules.repair(load(spark, d, "laboratory"), "id", [FilterTerm("glu", "=", "normal"), FilterTerm("ldh", ">", -1)], "GLU: 70-110")
    return rows(spark, [(p.rule, p.original[0].column) for p in found if p.rule in ("normal_range", "coverage")], "rule string, column_name string")


_LABELS = {
    "as_is": "o_totalprice > 300000 AND o_orderstatus = 'F'", "without_o_totalprice": "o_orderstatus = 'F'", "without_o_orderstatus": "o_totalprice > 300000", "any_of": "o_totalprice > 300000 OR o_orderstatus = 'F'", "wider_o_totalprice": "o_totalprice > 285000 AND o_orderstatus = 'F'",
    "inverted_o_totalprice": "o_totalprice <= 300000 AND o_orderstatus = 'F'", "like_o_orderstatus": "o_totalprice > 300000 AND o_orderstatus ILIKE '%F%'", "across_rows": "o_totalprice > 300000 AND o_orderstatus = 'F'", "latest": "o_totalprice > 300000 AND o_orderstatus = 'F'", "distinct": "o_totalprice > 300000 AND o_orderstatus = 'F'",
}


@query("hypotheses", "WITH k AS (" + " UNION ALL ".join(f"SELECT '{k}' AS label, count(DISTINCT CASE WHEN {c} THEN o_custkey END) AS n FROM orders" for k, c in _LABELS.items()) + ") SELECT label, n, CASE WHEN n = 0 THEN -100.0 WHEN n <= 50 THEN 15.0 ELSE 10.0 END AS score FROM k WHERE label <> 'across_rows' OR (SELECT count(*) / count(DISTINCT o_custkey) > 1.5 FROM orders)")
def _(spark, d):
    o = load(spark, d, "orders")
    found = rules.hypotheses(o, "o_custkey", [_PRICE, _STATUS], "the latest distinct orders")
    return rows(spark, [(h.label, n, s) for s, n, h in rules.scored(o, "o_custkey", found)], "label string, n bigint, score double")


@query("hypotheses_of_numbers", "WITH s AS (SELECT min(l_quantity) lo, max(l_quantity) hi, avg(l_quantity) m FROM lineitem), k AS (SELECT 'percent_l_quantity' AS label, count(DISTINCT CASE WHEN l_quantity >= round(lo + (hi - lo) * 0.9, 2) THEN l_orderkey END) AS n FROM lineitem, s UNION ALL SELECT 'mean_l_quantity', count(DISTINCT CASE WHEN l_quantity > round(m, 4) THEN l_orderkey END) FROM lineitem, s UNION ALL SELECT 'outlier_l_quantity', count(DISTINCT CASE WHEN l_quantity < round(m - 2.5 * (hi - lo) / 4, 2) OR l_quantity > round(m + 2.5 * (hi - lo) / 4, 2) THEN l_orderkey END) FROM lineitem, s) SELECT * FROM k")
def _(spark, d):
    li = load(spark, d, "lineitem")
    found = rules.hypotheses(li, "l_orderkey", [FilterTerm("l_quantity", ">", 30)], "unusual quantities above average, the top 10 % overall")
    wanted = [h for h in found if h.label.split("_")[0] in ("percent", "mean", "outlier")]
    return rows(spark, [(h.label, n) for _, n, h in rules.scored(li, "l_orderkey", wanted)], "label string, n bigint")


# --- scoring, merging, memory, streaming --------------------------------------------


@query("compare_rows", "SELECT n_nationkey AS place, n_nationkey % 2 = 0 AS contained FROM nation")
def _(spark, d):
    n = load(spark, d, "nation")
    predicted = n.select("n_nationkey", F.col("n_regionkey").alias("x"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("other").alias("y"), F.lit("more").alias("z"))
    return scoring.positional_match(predicted, n.select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


@query("same_rows", "SELECT true AS shuffled, false AS changed")
def _(spark, d):
    n = load(spark, d, "nation")
    return rows(spark, [(scoring.same_rows(n, n.orderBy(F.desc("n_name"))), scoring.same_rows(n, n.limit(3)))], "shuffled boolean, changed boolean")


@query("signature_scores", "SELECT 'renamed' AS answer, 1.0 AS score UNION ALL SELECT 'one_missing', round(2 / 3, 6) UNION ALL SELECT 'one_extra', round(1 - 0.2 / 4, 6) UNION ALL SELECT 'one_wrong_cell', round(2 / 3 - 0.2 / 3, 6)")
def _(spark, d):
    """Scores of answers to the nation table by the rule matched / gold - 0.2 * extra / predicted."""
    n = load(spark, d, "nation")
    wrong = F.when(F.col("n_nationkey") == 0, F.lit("nowhere")).otherwise(F.col("n_name"))
    answers = {"renamed": n.select(F.col("n_regionkey").alias("a"), F.col("n_name").alias("b"), F.col("n_nationkey").alias("c")), "one_missing": n.select("n_name", "n_regionkey"), "one_extra": n.withColumn("e", F.lit("x")), "one_wrong_cell": n.withColumn("n_name", wrong)}
    scored = [scoring.score_prediction(df, n).select(F.lit(a).alias("answer"), "score") for a, df in answers.items()]
    return scored[0].unionByName(scored[1]).unionByName(scored[2]).unionByName(scored[3])


@query("merge_target", "SELECT 'customer' AS target WHERE (SELECT count(DISTINCT o_custkey) FILTER (o_custkey IN (SELECT c_custkey FROM customer)) > 0.5 * count(DISTINCT o_custkey) FROM orders)")
def _(spark, d):
    found = merge.best_merge_target(load(spark, d, "orders"), "o_custkey", {"customer": (load(spark, d, "customer"), "c_custkey"), "region": (load(spark, d, "region"), "r_regionkey")})
    return rows(spark, [(found,)] if found else [], "target string")


@query("id_key", "SELECT CASE WHEN (SELECT count(deleted_at) > 0.5 * count(*) FROM patient) THEN 'deleted_at' ELSE 'id' END AS key WHERE (SELECT count(*) FILTER (id <> '') > 0.5 * count(*) FROM patient)")
def _(spark, d):
    return rows(spark, [(merge.detect_id_key(load(spark, d, "patient"), ["record_no", "deleted_at", "id"]),)], "key string")


@query("records_table", "WITH p AS (SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type <> '') AS event_type, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value FROM events WHERE user_id IS NOT NULL GROUP BY user_id) SELECT * FROM p WHERE event_type IS NOT NULL OR value IS NOT NULL")
def _(spark, d):
    e = load(spark, d, "events").select("user_id", "event_type", "value", F.when(F.col("event_id") == 1, "x").alias("rare"), F.struct("ts", "event_id").alias("at"))
    return merge.records_table(e, "user_id", "at", least=0.5)


@query("case_variants", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS Name FROM nation")
def _(spark, d):
    n = load(spark, d, "nation")
    both = n.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("a"), F.lower("n_name").alias("b")).toDF("n_nationkey", "Name", "NAME")
    return merge.merge_case_variants(both)


@query("memory_roundtrip", "SELECT action AS node, task_id AS subject, count(*) AS facts FROM (SELECT DISTINCT action, task_id, run_id FROM step_record WHERE action IS NOT NULL AND task_id IS NOT NULL AND run_id IS NOT NULL) GROUP BY ALL")
def _(spark, d):
    s = load(spark, d, "step_record").where("action is not null and task_id is not null and run_id is not null")
    facts = memory.upsert_facts(s.select(F.col("action").alias("node"), F.col("task_id").alias("subject"), F.col("run_id").alias("fact"), F.col("step_id").alias("at")))
    folder, mark = f"{work_folder(spark)}/facts", memory.fingerprint({"step_record": s.columns})
    memory.save_facts(facts, folder, mark)
    memory.save_facts(facts.limit(1), folder, "another")
    return memory.load_facts(spark, folder, mark).groupBy("node", "subject").agg(F.count("*").alias("facts"))


@query("stream_upserts", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def _(spark, d):
    """The streamed upsert itself: the events arrive as a stream of files, micro-batch by micro-batch, and one file twice."""
    from tamarack.streaming import upsert

    folder = work_folder(spark)
    e = load(spark, d, "events").where("user_id is not null").select("user_id", "event_type", "value", "ts", "event_id")
    e.repartition(3, "event_id").write.parquet(f"{folder}/in")
    e.where("event_id % 7 = 0").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withColumn("at", F.struct("ts", "event_id")).drop("ts", "event_id")
    return upsert.run_upserts(spark, stream, "user_id", "at", f"{folder}/out").select("user_id", "event_type", "value")
