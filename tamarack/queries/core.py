"""Queries of the relational operators, each with the DuckDB statement of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.operators import documents as D
from tamarack.operators import graph, lookup, merge, probes, profile, scoring
from tamarack.operators import prose as P
from tamarack.plans import planner
from tamarack.session import load

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its statement."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def star(spark, d: str) -> dict[str, DataFrame]:
    return {t: load(spark, d, t) for t in STAR}


# --- profiles ---------------------------------------------------------------

_NUMERIC = {
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax",
    "orders": "o_orderkey o_custkey o_totalprice",
    "events": "event_id user_id value",
    "laboratory": "lab_id got gpt ldh alp tp alb ua un cre t_bil glu wbc rbc hgb hct plt",
}
_OTHER = {"lineitem": "l_returnflag l_linestatus l_shipdate", "orders": "o_orderstatus o_orderdate o_orderpriority", "events": "ts event_type props", "laboratory": "id exam_date loaded_at"}


def _profile_sql(table: str) -> str:
    parts = []
    for c in (_NUMERIC[table] + " " + _OTHER[table]).split():
        numeric = c in _NUMERIC[table].split()
        stats = f"CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE), round(avg({c}), 2)" if numeric else "NULL, NULL, NULL"
        parts.append(f"SELECT '{c}', count(*), count({c}), count(DISTINCT {c}), (((count(*) - count({c})) * 2000 + count(*)) // greatest(2 * count(*), 1)) / 1000.0, ((count(DISTINCT {c}) * 20000 + count(*)) // greatest(2 * count(*), 1)) / 10000.0, {stats} FROM {table}")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) t(column_name, total, non_null, distinct_count, null_ratio, cardinality_ratio, min_value, max_value, avg_value)"


for _t in _NUMERIC:
    query(f"profile_{_t}", _profile_sql(_t))(lambda spark, d, t=_t: profile.column_profile(load(spark, d, t)))

_PART_TEXTS = "SELECT 'p_name' c, p_name v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_type', p_type FROM part"


@query(
    "mode_per_column",
    f"""WITH t AS ({_PART_TEXTS}), k AS (SELECT c, v, count(*) n FROM t WHERE v IS NOT NULL GROUP BY c, v),
    s AS (SELECT c, count(*) d, sum(n) a FROM k GROUP BY c), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) p FROM k)
    SELECT r.c AS column_name, v AS mode, n, round(n / a, 6) AS frequency FROM r JOIN s USING (c) WHERE p = 1 AND d <= 200""",
)
def _(spark, d):
    return profile.modes(load(spark, d, "part"))


@query("top_values_part", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def _(spark, d):
    counts = load(spark, d, "part").groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n"))
    return probes.top_k(counts, 10, F.desc("n"), F.col("value"))


@query(
    "value_index_part",
    f"""WITH t AS ({_PART_TEXTS}), k AS (SELECT c, v, count(*) n FROM t WHERE trim(v) <> '' GROUP BY c, v),
    s AS (SELECT c, count(*) d, sum(n) a FROM k GROUP BY c), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) p FROM k)
    SELECT r.c AS column_name, v AS value, lower(trim(v)) AS key, n, round(n / a, 6) AS frequency FROM r JOIN s USING (c) WHERE p <= 200 AND d <= 500""",
)
def _(spark, d):
    return profile.value_index(load(spark, d, "part"))


@query("value_index_hits", "SELECT 'p_type' AS column_name, p_type AS value, count(*) AS n FROM part WHERE lower(p_type) LIKE '%steel%' GROUP BY 2")
def _(spark, d):
    return profile.value_counts(load(spark, d, "part"), ["p_type"]).where(F.lower("value").contains("steel"))


def _percentiles(spark, got: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in got.items()], "point string, value double")


def _percentile_sql(expressions: dict[str, str], table: str, column: str, digits: int | None = None) -> str:
    value = f"round(v, {digits})" if digits is not None else "v"
    parts = " UNION ALL ".join(f"SELECT '{p}' AS point, CAST({value} AS DOUBLE) AS value FROM r, n WHERE i = {e}" for p, e in expressions.items())
    return f"WITH r AS (SELECT {column} v, row_number() OVER (ORDER BY {column}) - 1 i FROM {table} WHERE {column} IS NOT NULL), n AS (SELECT count(*) n FROM r) {parts}"


@query("percentiles_floor_index", _percentile_sql({f"p{p}": f"least(greatest(n * {p} // 100, 0), n - 1)" for p in (10, 25, 50, 75, 90)}, "orders", "o_totalprice"))
def _(spark, d):
    return _percentiles(spark, profile.floor_percentiles(load(spark, d, "orders"), "o_totalprice"))


@query("percentiles_profile", _percentile_sql({"p25": "greatest(0, n // 4 - 1)", "p75": "greatest(0, 3 * n // 4 - 1)"}, "laboratory", "ldh", 2))
def _(spark, d):
    return _percentiles(spark, profile.profile_quartiles(load(spark, d, "laboratory"), "ldh"))


_RANGE = _percentile_sql({f"p{p}": f"greatest(n * {p} // 100 - 1, 0)" for p in (5, 25, 50, 75, 95)}, "laboratory", "glu")


@query("percentiles_range", _RANGE)
def _(spark, d):
    return _percentiles(spark, profile.range_percentiles(load(spark, d, "laboratory"), "glu"))


@query(
    "histogram_5",
    """WITH m AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders)
    SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 5)), 4) AS INTEGER) AS bucket, count(*) AS n FROM orders, m GROUP BY 1""",
)
def _(spark, d):
    return profile.histogram(load(spark, d, "orders"), "o_totalprice").select("bucket", "n")


_FENCES = f"""p AS ({_RANGE}), q AS (SELECT max(value) FILTER (point = 'p25') a, max(value) FILTER (point = 'p75') b FROM p),
    f AS (SELECT round(a - 1.5 * (b - a), 4) lo, round(b + 1.5 * (b - a), 4) hi FROM q)"""


@query("iqr_fences", f"WITH {_FENCES} SELECT lo AS low, hi AS high FROM f")
def _(spark, d):
    low, high = profile.fences(profile.range_percentiles(load(spark, d, "laboratory"), "glu"))
    return spark.createDataFrame([(low, high)], "low double, high double")


@query(
    "range_validation",
    f"""WITH {_FENCES}, c AS (SELECT count(*) FILTER (glu BETWEEN lo AND hi) i, count(*) FILTER (glu < lo) b, count(*) FILTER (glu > hi) a FROM laboratory, f)
    SELECT i AS inside, b AS below, a AS above, (i / (i + b + a) > 0.05 AND i / (i + b + a) < 0.99 AND b + a > 0) AS useful FROM c""",
)
def _(spark, d):
    lab = load(spark, d, "laboratory")
    return profile.range_validation(lab, "glu", *profile.fences(profile.range_percentiles(lab, "glu")))


@query(
    "outside_p10_p90",
    f"""WITH p AS ({_percentile_sql({f'p{p}': f'least(greatest(n * {p} // 100, 0), n - 1)' for p in (10, 90)}, 'orders', 'o_totalprice')}), q AS (SELECT min(value) a, max(value) b FROM p)
    SELECT round(100.0 * count(*) FILTER (o_totalprice < a OR o_totalprice > b) / count(*), 6) AS percent FROM orders, q""",
)
def _(spark, d):
    orders = load(spark, d, "orders")
    got = profile.floor_percentiles(orders, "o_totalprice", (10, 90))
    return orders.agg(profile.share_where((F.col("o_totalprice") < got["p10"]) | (F.col("o_totalprice") > got["p90"])).alias("percent"))


@query("value_spread", "SELECT round((max(o_totalprice) - min(o_totalprice)) / abs(avg(o_totalprice)), 6) AS spread, CASE WHEN (max(o_totalprice) - min(o_totalprice)) / abs(avg(o_totalprice)) < 1 THEN 'tight' WHEN (max(o_totalprice) - min(o_totalprice)) / abs(avg(o_totalprice)) > 5 THEN 'wide' ELSE 'moderate' END AS kind FROM orders")
def _(spark, d):
    return profile.value_spread(load(spark, d, "orders"), "o_totalprice")


@query("null_like_ratio", "SELECT 'diagnosis' AS column_name, round(avg(CASE WHEN diagnosis IS NULL OR diagnosis = '' OR coalesce(TRY_CAST(diagnosis AS DOUBLE) = 0, false) THEN 1.0 ELSE 0.0 END), 4) AS ratio, (count(*) > 5 AND avg(CASE WHEN diagnosis IS NULL OR diagnosis = '' OR coalesce(TRY_CAST(diagnosis AS DOUBLE) = 0, false) THEN 1.0 ELSE 0.0 END) > 0.8) AS warned FROM patient UNION ALL SELECT 'sex', round(avg(CASE WHEN sex IS NULL OR sex = '' OR coalesce(TRY_CAST(sex AS DOUBLE) = 0, false) THEN 1.0 ELSE 0.0 END), 4), (count(*) > 5 AND avg(CASE WHEN sex IS NULL OR sex = '' OR coalesce(TRY_CAST(sex AS DOUBLE) = 0, false) THEN 1.0 ELSE 0.0 END) > 0.8) FROM patient")
def _(spark, d):
    return profile.null_like_ratios(load(spark, d, "patient").select("diagnosis", "sex"))


# --- keys, joins, schema ----------------------------------------------------

_KEYS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("customer", "c_custkey", "orders", "o_custkey")]


@query(
    "fk_overlap_matrix",
    " UNION ALL ".join(f"SELECT '{a}.{k}' AS source, '{b}.{r}' AS target, count(*) AS sampled, count(*) FILTER (k IN (SELECT {r} FROM {b})) AS found FROM (SELECT DISTINCT {k} k FROM {a} WHERE {k} IS NOT NULL ORDER BY 1 LIMIT 50)" for a, k, b, r in _KEYS),
)
def _(spark, d):
    t = star(spark, d)
    frames = [graph.overlap(t[a], k, t[b], r).select(F.lit(f"{a}.{k}").alias("source"), F.lit(f"{b}.{r}").alias("target"), "sampled", "found") for a, k, b, r in _KEYS]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


_EDGES = [
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
]


@query("fk_edges", "SELECT * FROM (VALUES " + ", ".join(str(e) for e in _EDGES) + ") t(source_table, source_column, target_table, target_column)")
def _(spark, d):
    return graph.foreign_keys(spark, star(spark, d)).select("source_table", "source_column", "target_table", "target_column")


@query(
    "fk_cardinality",
    " UNION ALL ".join(
        f"SELECT '{a}.{k}' AS source, (CASE WHEN (SELECT count(DISTINCT {k}) >= count({k}) FROM {a}) THEN 'one' ELSE 'many' END) || '-to-' || (CASE WHEN (SELECT count(DISTINCT {r}) >= count({r}) FROM {b}) THEN 'one' ELSE 'many' END) AS cardinality" for a, k, b, r in _EDGES
    ),
)
def _(spark, d):
    return graph.foreign_keys(spark, star(spark, d)).select(F.concat_ws(".", "source_table", "source_column").alias("source"), "cardinality")


@query(
    "join_fan_out",
    "SELECT (SELECT count(*) FROM customer) AS source_rows, (SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey) AS joined_rows, round((SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey) / (SELECT count(*) FROM customer), 6) AS fan_out",
)
def _(spark, d):
    return probes.join_fan_out(load(spark, d, "customer"), "c_custkey", load(spark, d, "orders"), "o_custkey")


_DOMAIN = ("patient", "laboratory", "documents", "doc_subject_label", "club_event", "extraction_unit", "paragraph_unit")
_DOMAIN_COLUMNS = {
    "patient": "id sex birthday diagnosis admission first_date loaded_at deleted_at",
    "laboratory": "lab_id id exam_date got gpt ldh alp tp alb ua un cre t_bil glu wbc rbc hgb hct plt loaded_at",
    "documents": "doc_id text lang source n_chars task_id added_at",
    "doc_subject_label": "doc_id subject_id labeller labelled_at",
    "club_event": "event_id event_name event_type event_status loaded_at deleted_at",
    "extraction_unit": "unit_id doc_path section_heading text token_estimate built_at",
    "paragraph_unit": "unit_id doc_path text token_estimate unit_state claimed_by",
}


@query(
    "shared_columns",
    "SELECT c AS column_name, string_agg(t, ',' ORDER BY t) AS tables FROM (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in _DOMAIN_COLUMNS.items() for c in cs.split()) + ") x(t, c) GROUP BY c HAVING count(DISTINCT t) > 1",
)
def _(spark, d):
    return graph.shared_columns(spark, {t: load(spark, d, t) for t in _DOMAIN})


_DATES = {"birthday", "first_date", "exam_date"}
_TIMES = {"loaded_at", "deleted_at", "added_at", "labelled_at", "built_at"}
_LONGS = {"lab_id", "doc_id", "n_chars", "unit_id"}
_LAB_NUMBERS = set("got gpt ldh alp tp alb ua un cre t_bil glu wbc rbc hgb hct plt".split())
_kind = lambda c: "date" if c in _DATES else "time" if c in _TIMES else "long" if c in _LONGS else "double" if c in _LAB_NUMBERS else "int" if c == "token_estimate" else "text"
_COLUMN_ROWS = ", ".join(f"('{t}', '{c}', '{_kind(c)}')" for t, cs in _DOMAIN_COLUMNS.items() for c in cs.split())


# Words of names; the same name is 1, common words by their share and a tenth for the same type, else words that begin alike.
@query(
    "column_similarity",
    f"""WITH c(t, n, k) AS (VALUES {_COLUMN_ROWS}), w AS (SELECT *, list_filter(string_split(lower(n), '_'), lambda x: length(x) >= 2) AS ws FROM c),
    p AS (SELECT a.t AS lt, a.n AS ln, b.t AS rt, b.n AS rn, lower(a.n) = lower(b.n) AS same, a.k = b.k AS kind, len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) AS j,
      len(list_filter(a.ws, lambda u: len(list_filter(b.ws, lambda v: least(length(u), length(v)) >= 5 AND (starts_with(u, v) OR starts_with(v, u)))) > 0)) AS stems FROM w a JOIN w b ON a.t <> b.t AND (a.t, a.n) < (b.t, b.n) AND len(a.ws) > 0 AND len(b.ws) > 0),
    s AS (SELECT *, CASE WHEN same THEN 1.0 WHEN j = 0 THEN least(0.3 * stems, 0.4) ELSE least(1.0, j + CASE WHEN kind THEN 0.1 ELSE 0 END) END AS v FROM p)
    SELECT lt AS left_table, ln AS left_column, rt AS right_table, rn AS right_column, round(v, 6) AS similarity FROM s WHERE v >= 0.5""",
)
def _(spark, d):
    return graph.column_similarity(spark, {t: load(spark, d, t) for t in _DOMAIN})


@query(
    "table_roles",
    """SELECT * FROM (VALUES ('lineitem', 'fact'), ('orders', 'fact'), ('customer', 'dimension'), ('supplier', 'dimension'), ('part', 'dimension'), ('nation', 'dimension'), ('region', 'dimension')) t(table_name, role)""",
)
def _(spark, d):
    t = star(spark, d)
    return graph.table_roles(spark, t, graph.foreign_keys(spark, t)).select("table_name", "role")


@query("dim_model", "SELECT * FROM (VALUES ('lineitem', 'orders', 'l_orderkey'), ('lineitem', 'part', 'l_partkey'), ('lineitem', 'supplier', 'l_suppkey')) t(fact_table, dimension, key_column)")
def _(spark, d):
    t = star(spark, d)
    edges = graph.foreign_keys(spark, t)
    return graph.dimensional_model(spark, t, edges, graph.table_roles(spark, t, edges)).select("fact_table", "dimension", "key_column")


@query("hierarchy_members", "SELECT DISTINCT r_name AS parent, n_name AS child FROM region JOIN nation ON r_regionkey = n_regionkey")
def _(spark, d):
    return graph.members(load(spark, d, "region"), "r_regionkey", "r_name", load(spark, d, "nation"), "n_regionkey", "n_name")


_EDGE_VALUES = ", ".join(f"('{a}', '{c}')" for a, _, c, _ in _EDGES)
_PATHS = f"""WITH RECURSIVE e(a, b) AS (SELECT * FROM (VALUES {_EDGE_VALUES}) v(a, b) UNION SELECT b, a FROM (VALUES {_EDGE_VALUES}) v(a, b)),
    p(tip, path, n) AS (SELECT 'orders', ['orders'], 0 UNION ALL SELECT e.b, list_append(p.path, e.b), n + 1 FROM p JOIN e ON e.a = p.tip WHERE n < 4 AND NOT list_contains(p.path, e.b) AND p.tip <> 'region')"""


@query("join_paths", _PATHS + " SELECT array_to_string(path, '>') AS path, n AS edges FROM p WHERE tip = 'region'")
def _(spark, d):
    edges = [planner.Edge(*e) for e in _EDGES]
    rows = [(">".join(["orders", *(e.target for e in p)]), len(p)) for p in planner.all_paths(edges, "orders", "region", 4)]
    return spark.createDataFrame(rows, "path string, edges int")


@query("shortest_path", _PATHS + " SELECT array_to_string(path, '>') AS path, n AS edges FROM p WHERE tip = 'region' ORDER BY n, path LIMIT 1")
def _(spark, d):
    path = planner.shortest_path([planner.Edge(*e) for e in _EDGES], "orders", "region")
    return spark.createDataFrame([(">".join(["orders", *(e.target for e in path)]), len(path))], "path string, edges int")


@query("steiner_region_sales", "SELECT r_name, round(sum(o_totalprice), 2) AS sales FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, d):
    t = star(spark, d)
    edges = planner.edges_of(graph.foreign_keys(spark, t))
    plan = planner.Plan([planner.Output("region", "r_name"), planner.Output("orders", "o_totalprice", "sum", "sales")])
    return planner.compile_plan(plan, t, edges).withColumn("sales", F.round("sales", 2))


@query(
    "planned_filter_join",
    "SELECT DISTINCT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
def _(spark, d):
    t = star(spark, d)
    plan = planner.Plan([planner.Output("customer", "c_name"), planner.Output("nation", "n_name")], [planner.Filter("orders", "o_totalprice", ">", 400000), planner.Filter("customer", "c_mktsegment", "IN", ["BUILDING", "MACHINERY"])])
    return planner.compile_plan(plan, t, [planner.Edge(*e) for e in _EDGES])


# --- probes -----------------------------------------------------------------


@query("rows_per_entity", "SELECT count(*) AS row_count, count(DISTINCT o_custkey) AS entities, round(count(*) / greatest(count(DISTINCT o_custkey), 1), 6) AS rows_per_entity FROM orders")
def _(spark, d):
    return probes.rows_per_entity(load(spark, d, "orders"), "o_custkey")


_A, _B = "o_totalprice > 300000", "o_orderstatus = 'F'"


@query("cooccurrence", f"SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE {_A} AND {_B}) AS same_row, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE {_A} INTERSECT SELECT o_custkey FROM orders WHERE {_B})) AS across_rows")
def _(spark, d):
    return probes.co_occurrence(load(spark, d, "orders"), "o_custkey", F.col("o_totalprice") > 300000, F.col("o_orderstatus") == "F")


@query("cross_row_semi", f"SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE {_A}) AND o_custkey IN (SELECT o_custkey FROM orders WHERE {_B})")
def _(spark, d):
    return probes.entities_with_all(load(spark, d, "orders"), "o_custkey", [F.col("o_totalprice") > 300000, F.col("o_orderstatus") == "F"])


_C = "o_orderpriority = '1-URGENT'"


@query(
    "drop_one",
    f"SELECT '' AS dropped, count(DISTINCT o_custkey) AS entities FROM orders WHERE {_A} AND {_B} AND {_C} UNION ALL SELECT 'price', count(DISTINCT o_custkey) FROM orders WHERE {_B} AND {_C} UNION ALL SELECT 'status', count(DISTINCT o_custkey) FROM orders WHERE {_A} AND {_C} UNION ALL SELECT 'priority', count(DISTINCT o_custkey) FROM orders WHERE {_A} AND {_B}",
)
def _(spark, d):
    return probes.drop_one(load(spark, d, "orders"), "o_custkey", {"price": F.col("o_totalprice") > 300000, "status": F.col("o_orderstatus") == "F", "priority": F.col("o_orderpriority") == "1-URGENT"})


@query("set_intersect", f"SELECT o_custkey FROM orders WHERE {_A} INTERSECT SELECT o_custkey FROM orders WHERE {_B}")
def _(spark, d):
    o = load(spark, d, "orders")
    return o.where(_A).select("o_custkey").intersect(o.where(_B).select("o_custkey"))


@query("set_union_except", f"(SELECT o_custkey FROM orders WHERE {_A} UNION SELECT o_custkey FROM orders WHERE {_C}) EXCEPT SELECT o_custkey FROM orders WHERE {_B}")
def _(spark, d):
    o = load(spark, d, "orders")
    return o.where(_A).select("o_custkey").unionByName(o.where(_C).select("o_custkey")).distinct().subtract(o.where(_B).select("o_custkey"))


@query("anti_no_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(spark, d):
    rich = load(spark, d, "orders").where("o_totalprice > 300000")
    return load(spark, d, "customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("count_matching", f"SELECT 'price' AS probe, count(*) FILTER ({_A}) AS n FROM orders UNION ALL SELECT 'status', count(*) FILTER ({_B}) FROM orders UNION ALL SELECT 'priority', count(*) FILTER ({_C}) FROM orders UNION ALL SELECT 'between', count(*) FILTER (o_totalprice BETWEEN 1000 AND 2000) FROM orders")
def _(spark, d):
    return probes.count_matching(load(spark, d, "orders"), {"price": probes.predicate("o_totalprice", ">", 300000), "status": probes.predicate("o_orderstatus", "=", "F"), "priority": probes.predicate("o_orderpriority", "IN", ["1-URGENT"]), "between": probes.predicate("o_totalprice", "BETWEEN", (1000, 2000))})


@query("vacuous_filter_probe", "WITH c AS (SELECT count(*) FILTER (l_quantity > 0 AND l_discount > 0.05) a, count(*) FILTER (l_discount > 0.05) q, count(*) FILTER (l_quantity > 0) d FROM lineitem) SELECT 'quantity' AS filter, a AS with_filter, q AS without_filter, (a = q AND a > 1) AS vacuous FROM c UNION ALL SELECT 'discount', a, d, (a = d AND a > 1) FROM c")
def _(spark, d):
    return probes.vacuous_filters(load(spark, d, "lineitem"), {"quantity": F.col("l_quantity") > 0, "discount": F.col("l_discount") > 0.05})


@query("temporal_prefix_filter", "SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-03-15'")
def _(spark, d):
    return load(spark, d, "orders").where(F.to_date("o_orderdate") == F.lit("1995-03-15").cast("date")).agg(F.count("*").alias("n"))


@query("existence_filter", "SELECT count(*) FILTER (deleted_at IS NOT NULL) AS there, round(1 - count(deleted_at) / count(*), 6) AS null_ratio, (1 - count(deleted_at) / count(*) > 0.7) AS sparse FROM patient")
def _(spark, d):
    row = load(spark, d, "patient").agg(F.count("deleted_at").alias("there"), F.count("*").alias("n"))
    ratio = 1 - F.col("there") / F.col("n")
    return row.select("there", F.round(ratio, 6).alias("null_ratio"), (ratio > 0.7).alias("sparse"))


@query("equality_or_in", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') GROUP BY 1")
def _(spark, d):
    return load(spark, d, "customer").where(probes.predicate("c_mktsegment", "=", "BUILDING") | probes.predicate("c_mktsegment", "IN", ["MACHINERY", "HOUSEHOLD"])).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("impossible_threshold", "SELECT 'high' AS probe, count(*) FILTER (l_quantity > 1000000) AS n FROM lineitem UNION ALL SELECT 'low', count(*) FILTER (l_quantity < -5) FROM lineitem")
def _(spark, d):
    return probes.count_matching(load(spark, d, "lineitem"), {"high": F.col("l_quantity") > 1000000, "low": F.col("l_quantity") < -5})


@query("ratio_percentage", "SELECT round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS percent FROM lineitem")
def _(spark, d):
    return load(spark, d, "lineitem").agg(profile.share_where(F.col("l_returnflag") == "R").alias("percent"))


@query("ratio_independent", "SELECT round((SELECT count(*) FROM orders) / (SELECT count(*) FROM customer), 6) AS ratio")
def _(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("tamarack_orders")
    load(spark, d, "customer").createOrReplaceTempView("tamarack_customer")
    return spark.sql("SELECT round((SELECT count(*) FROM tamarack_orders) / (SELECT count(*) FROM tamarack_customer), 6) AS ratio")


@query("avg_x_per_y", "SELECT round(count(o_orderkey) / count(DISTINCT o_custkey), 6) AS orders_per_customer FROM orders")
def _(spark, d):
    return load(spark, d, "orders").agg(F.round(F.count("o_orderkey") / F.count_distinct("o_custkey"), 6).alias("orders_per_customer"))


@query("period_average", "SELECT year(o_orderdate) AS y, round(sum(o_totalprice) / 12, 2) AS per_month FROM orders GROUP BY 1")
def _(spark, d):
    return load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice") / 12, 2).alias("per_month"))


@query("group_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def _(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


@query("five_aggregates", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_extendedprice), 4) AS mean, min(l_discount) AS low, max(l_tax) AS high FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def _(spark, d):
    li = load(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_discount").alias("low"), F.max("l_tax").alias("high"))


@query("latest_per_entity", "SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) r FROM orders) WHERE r = 1")
def _(spark, d):
    return probes.latest(load(spark, d, "orders"), "o_custkey", "o_orderdate").select("o_custkey", "o_orderkey")


@query("first_vs_last", "SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_value, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_value FROM orders GROUP BY 1")
def _(spark, d):
    return probes.first_and_last(load(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")


@query("extreme_ties", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)")
def _(spark, d):
    return probes.extremes_with_ties(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, d):
    return probes.top_k(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("topk_per_group", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) p FROM customer) WHERE p <= 3")
def _(spark, d):
    return probes.top_per_group(load(spark, d, "customer"), "c_mktsegment", 3, F.desc("c_acctbal"), F.col("c_custkey")).select("c_mktsegment", "c_custkey")


@query("window_running", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("ci_like_match", "SELECT event_id FROM club_event WHERE event_type ILIKE '%meet%'")
def _(spark, d):
    return load(spark, d, "club_event").where(F.col("event_type").ilike("%meet%")).select("event_id")


@query(
    "fuzzy_tokens",
    "WITH t AS (SELECT DISTINCT p_name, list_distinct(string_split(lower(p_name), ' ')) w FROM part WHERE p_name IS NOT NULL) SELECT p_name FROM t WHERE len(list_intersect(w, string_split('small green widget', ' '))) / least(len(w), 3) > 0.5",
)
def _(spark, d):
    names = load(spark, d, "part").where("p_name is not null").select("p_name").distinct()
    return names.where(lookup.overlap_with(F.col("p_name"), "small green widget") > 0.5)


@query("prefix_candidates", "SELECT DISTINCT event_id FROM club_event WHERE starts_with(event_id, 'recA') OR starts_with(event_id, 'recB')")
def _(spark, d):
    return load(spark, d, "club_event").where(F.col("event_id").startswith("recA") | F.col("event_id").startswith("recB")).select("event_id").distinct()


# --- merging and scoring ----------------------------------------------------




@query(
    "merge_non_null_wins",
    "SELECT id, arg_max(sex, loaded_at) FILTER (sex IS NOT NULL AND sex <> '') AS sex, arg_max(diagnosis, loaded_at) FILTER (diagnosis IS NOT NULL AND diagnosis <> '') AS diagnosis FROM patient WHERE id IS NOT NULL GROUP BY id",
)
def _(spark, d):
    return merge.merge_last_filled(load(spark, d, "patient").select("id", "sex", "diagnosis", "loaded_at"), "id", "loaded_at")


@query(
    "merge_confidence",
    """WITH v AS (SELECT step_id % 500 AS record, action AS field, thought AS value, CASE step_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, step_id % 7 = 0 AS is_correction, step_id AS place FROM step_record WHERE action IS NOT NULL AND thought IS NOT NULL)
    SELECT record, field, coalesce(arg_min(value, place) FILTER (confidence = 'high'), arg_min(value, place) FILTER (is_correction), arg_max(value, place)) AS value FROM v GROUP BY record, field""",
)
def _(spark, d):
    steps = load(spark, d, "step_record").where("action is not null and thought is not null")
    m = F.col("step_id") % 3
    values = steps.select((F.col("step_id") % 500).alias("record"), F.col("action").alias("field"), F.col("thought").alias("value"), F.when(m == 0, "high").when(m == 1, "medium").otherwise("low").alias("confidence"), (F.col("step_id") % 7 == 0).alias("is_correction"), F.col("step_id").alias("place"))
    return merge.merge_by_confidence(values)


@query(
    "dedup_most_populated",
    "SELECT diagnosis, id, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY diagnosis ORDER BY (CASE WHEN id <> '' THEN 1 ELSE 0 END + CASE WHEN sex <> '' THEN 1 ELSE 0 END + CASE WHEN admission <> '' THEN 1 ELSE 0 END) DESC, id, loaded_at) p FROM patient WHERE diagnosis IS NOT NULL) WHERE p = 1",
)
def _(spark, d):
    p = load(spark, d, "patient").where("diagnosis is not null").select("diagnosis", "id", "sex", "admission", F.col("loaded_at"))
    return merge.keep_most_filled(p, "diagnosis", "id", "loaded_at").select("diagnosis", "id", "loaded_at")


@query(
    "upsert_fill_nulls",
    """WITH a AS (SELECT c_custkey AS k, nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey AS nation FROM customer WHERE c_mktsegment <> 'FURNITURE'), b AS (SELECT c_custkey AS k, lower(c_mktsegment) AS segment, c_name AS name FROM customer WHERE c_mktsegment <> 'MACHINERY')
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.segment, b.segment) AS segment, nation, name FROM a FULL JOIN b ON a.k = b.k""",
)
def _(spark, d):
    c = load(spark, d, "customer")
    a = c.where("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("k"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.col("c_nationkey").alias("nation"))
    b = c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("k"), F.lower("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    return merge.upsert_fill(a, b, "k")


@query("quantity_null_fill", "SELECT lab_id, coalesce(glu, 0) AS glu, coalesce(wbc, 0) AS wbc, ldh FROM laboratory")
def _(spark, d):
    return merge.fill_quantities(load(spark, d, "laboratory").select("lab_id", "glu", "wbc", "ldh"), ["glu", "wbc"])


@query("column_coverage", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM patient" for c in ("id", "sex", "diagnosis", "admission", "deleted_at")))
def _(spark, d):
    return merge.coverage(load(spark, d, "patient").select("id", "sex", "diagnosis", "admission", "deleted_at"))


@query("distinct_edges", "SELECT DISTINCT lower(source_type) AS s, lower(target_type) AS t, rel_type, trim(source_id) AS a, trim(target_id) AS b FROM relationships")
def _(spark, d):
    r = load(spark, d, "relationships")
    return merge.distinct_edges(r.select(F.lower("source_type").alias("s"), F.lower("target_type").alias("t"), "rel_type", F.trim("source_id").alias("a"), F.trim("target_id").alias("b")))


@query("ids_lacking_fields", "SELECT lab_id, concat_ws(',', CASE WHEN glu IS NULL THEN 'glu' END, CASE WHEN wbc IS NULL THEN 'wbc' END, CASE WHEN ldh IS NULL THEN 'ldh' END) AS missing FROM laboratory WHERE glu IS NULL OR wbc IS NULL OR ldh IS NULL")
def _(spark, d):
    return merge.ids_lacking(load(spark, d, "laboratory"), "lab_id", ["glu", "wbc", "ldh"])


@query("duplicate_rows", "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT doc_id, subject_id, count(*) n FROM doc_subject_label GROUP BY ALL)")
def _(spark, d):
    return scoring.duplicate_rows(load(spark, d, "doc_subject_label").select("doc_id", "subject_id"))


@query("column_signature_score", "SELECT 3 AS matched, 3 AS gold_columns, 4 AS predicted_columns, 0.95 AS score")
def _(spark, d):
    n = load(spark, d, "nation")
    predicted = n.select(F.col("n_name").alias("country"), F.col("n_regionkey").alias("area"), F.col("n_nationkey").cast("double").alias("number"), F.lit("x").alias("extra"))
    return scoring.score_prediction(predicted, n)


@query("score_by_group", "SELECT difficulty, count(*) AS tasks, round(avg((item_id % 5) / 4.0), 6) AS mean_score, count(*) FILTER (item_id % 5 = 4) AS perfect, count(*) FILTER (item_id % 5 = 0) AS failed FROM eval_item GROUP BY difficulty")
def _(spark, d):
    return scoring.score_report(load(spark, d, "eval_item").select("difficulty", ((F.col("item_id") % 5) / 4.0).alias("score")))


@query(
    "normalize_cells",
    "SELECT lab_id, CASE WHEN glu IS NULL OR isnan(glu) THEN '' ELSE CAST(CAST(round(CAST(glu AS DECIMAL(38,10)), 2) AS DECIMAL(38,2)) AS VARCHAR) END AS glu, CASE WHEN id IS NULL OR lower(trim(id)) IN ('', 'null', 'none', 'nan', 'nat', '<na>', 'n/a', 'na') THEN '' WHEN TRY_CAST(trim(id) AS DECIMAL(38,10)) IS NOT NULL THEN CAST(CAST(round(TRY_CAST(trim(id) AS DECIMAL(38,10)), 2) AS DECIMAL(38,2)) AS VARCHAR) ELSE trim(id) END AS id FROM laboratory",
)
def _(spark, d):
    return load(spark, d, "laboratory").select("lab_id", scoring.normalise_cell(F.col("glu")).alias("glu"), scoring.normalise_cell(F.col("id")).alias("id"))


# --- documents --------------------------------------------------------------


@query("doc_lines", "SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) l FROM documents WHERE text IS NOT NULL) WHERE trim(l) <> '' GROUP BY doc_id")
def _(spark, d):
    return D.lines(load(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("doc_sections", "SELECT doc_id, count(*) AS headings FROM (SELECT doc_id, unnest(string_split(text, chr(10))) l FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(l, '^#{2,4}[ \\t]+') GROUP BY doc_id")
def _(spark, d):
    return D.sections(load(spark, d, "documents")).where("level is not null").groupBy("doc_id").agg(F.count("*").alias("headings"))


_ID_RE, _NUM_RE = r"\b(?:[0-9]{5,}|rec[A-Za-z0-9]{8,})\b", r"-?[0-9]+(?:\.[0-9]+)?"


@query(
    "doc_data_density",
    f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) l FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, count(*) AS parts, round(avg(CASE WHEN length(l) >= 30 AND (regexp_matches(l, '{_ID_RE}') OR len(regexp_extract_all(l, '{_NUM_RE}')) >= 2) THEN 1.0 ELSE 0.0 END), 6) AS density FROM l WHERE trim(l) <> '' GROUP BY doc_id) SELECT *, density >= 0.3 AS kept FROM k",
)
def _(spark, d):
    return D.data_density(D.lines(load(spark, d, "documents")), "doc_id", "line")


@query("doc_ids", f"SELECT doc_id, unnest(regexp_extract_all(text, '{_ID_RE}')) AS id FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return D.ids(load(spark, d, "documents")).select("doc_id", "id")


def packed_sql(parts: str, limit: int, most: int | None, total: str, unit: str) -> str:
    """A statement of greedy packing, part after part; parts: doc_id, k, size."""
    fits = f"w.total + p.size <= {limit}" + (f" AND w.parts < {most}" if most else "")
    return f"""WITH RECURSIVE s AS ({parts}), p AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM s),
    w AS (SELECT doc_id, i, size AS total, 1 AS parts, 0 AS unit FROM p WHERE i = 1
      UNION ALL SELECT p.doc_id, p.i, CASE WHEN {fits} THEN w.total + p.size ELSE p.size END, CASE WHEN {fits} THEN w.parts + 1 ELSE 1 END, CASE WHEN {fits} THEN w.unit ELSE w.unit + 1 END FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1)
    SELECT doc_id, unit AS {unit}, max(total) AS {total}, max(parts) AS parts FROM w GROUP BY doc_id, unit"""


_LINES = "SELECT doc_id, k, length(v) // 4 AS size FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL) WHERE trim(v) <> ''"


@query("doc_units_packed", packed_sql(_LINES, 300, None, "tokens", "unit"))
def _(spark, d):
    return D.pack_parts(load(spark, d, "documents").where("text is not null"), 300)


@query("doc_length", "SELECT doc_id, length(text) AS chars, length(text) // 4 AS tokens FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("chars"), F.floor(F.length("text") / 4).alias("tokens"))


def prose(spark, d: str, *kept: str) -> DataFrame:
    """One paragraph per order, as the document operators meet them: value, correction, date, status."""
    o = load(spark, d, "orders")
    price = F.format_string("%.2f", "o_totalprice")
    start = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("PRICE was initially 1.0, later corrected to "), price)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("PRICE was "), price)).otherwise("PRICE was not available")
    return o.select(*kept, F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(": "), start, F.lit(". Priority "), F.col("o_orderpriority"), F.lit(".")).alias("text"))


_PRICE = "printf('%.2f', o_totalprice)"


# The first number behind the label, and none in the two cases where only a priority's digit follows.
@query("prose_extract_numeric", f"SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN CAST({_PRICE} AS DOUBLE) END AS value FROM orders")
def _(spark, d):
    return prose(spark, d).select("doc_id", P.number_after(F.col("text"), "PRICE").alias("value"))


@query("prose_corrections", f"SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST({_PRICE} AS DOUBLE) END AS value FROM orders")
def _(spark, d):
    return prose(spark, d).select("doc_id", P.corrected(F.col("text")).alias("value"))


@query("prose_missing", "SELECT o_orderkey AS doc_id, o_orderkey % 3 = 2 AS absent FROM orders")
def _(spark, d):
    return prose(spark, d).select("doc_id", D.missing_field(F.col("text"), "PRICE").alias("absent"))


@query("prose_dates", "SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS day FROM orders")
def _(spark, d):
    return prose(spark, d).select("doc_id", D.prose_date(F.col("text")).alias("day"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("prose_vocab", "SELECT o_orderkey AS doc_id, o_orderpriority AS priority FROM orders")
def _(spark, d):
    return prose(spark, d).select("doc_id", D.longest_contained(F.col("text"), _PRIORITIES).alias("priority"))


@query(
    "prose_merge_by_id",
    f"SELECT o_custkey AS record, coalesce(arg_min(v, k) FILTER (o_orderkey % 3 = 0), arg_max(v, k)) AS value FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN {_PRICE} END v, o_orderkey k FROM orders) WHERE v IS NOT NULL GROUP BY o_custkey",
)
def _(spark, d):
    p = prose(spark, d, "o_custkey").select(F.col("o_custkey").alias("doc_id"), F.col("doc_id").cast("int").alias("place"), "text")
    values = P.read_paragraphs(p, [P.Field("PRICE")]).where("field = 'PRICE'")
    same = values.select(F.col("doc_id").alias("record"), "field", "value", F.lit("medium").alias("confidence"), "is_correction", "place")
    return merge.merge_by_confidence(same).select("record", "value")


@query("prose_fields", "SELECT 'PRICE' AS field, count(*) AS n FROM orders WHERE o_orderkey % 3 = 1")
def _(spark, d):
    return D.discover_fields(prose(spark, d)).select("field", "n")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("event_types_per_day", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return load(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("table_previews", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
def _(spark, d):
    return probes.top_k(load(spark, d, "nation").select("n_nationkey", "n_name"), 5, F.col("n_nationkey"))


@query("schema_fingerprint", "SELECT substring(sha256('n_nationkey,n_name,n_regionkey'), 1, 16) AS fingerprint")
def _(spark, d):
    names = ",".join(load(spark, d, "nation").columns)
    return spark.range(1).select(F.substring(F.sha2(F.lit(names), 256), 1, 16).alias("fingerprint"))


@query("stream_upsert_events", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def _(spark, d):
    """The batch form of the streamed upsert: two halves folded apart and combined, as micro-batches are."""
    from tamarack.streaming import upsert

    e = load(spark, d, "events").select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    halves = [upsert.fold(e.where(F.pmod(F.xxhash64("at"), F.lit(2)) == k), "user_id", "at") for k in (0, 1)]
    return upsert.values(upsert.combine(*halves, "user_id"), "user_id")
