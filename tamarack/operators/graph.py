"""What a set of tables tells about itself: joinable columns, foreign keys, roles, similar columns.

Tables come as a dict name -> DataFrame. Results are metadata: rows per table,
column or pair of columns.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.operators.profile import is_numeric, is_text
from tamarack.session import materialise

SAMPLE_KEYS = 50


def column_table(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, place, type of every column."""
    rows = [(t, f.name, k, f.dataType.simpleString()) for t, df in tables.items() for k, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, place int, type string")


def shared_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """column_name, tables of columns that more than one table has."""
    return column_table(spark, tables).groupBy("column_name").agg(F.array_join(F.sort_array(F.collect_set("table_name")), ",").alias("tables")).where(F.col("tables").contains(","))


def name_tokens(name: str) -> frozenset[str]:
    """Words of two letters or more in a name: camel case, underscores and blanks part them."""
    return frozenset(w for w in re.split(r"[_\s]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()) if len(w) >= 2)


def name_similarity(a: str, type_a: str, b: str, type_b: str) -> float:
    """1 for the same name; else the share of common words, with a tenth more for the same type; 0.3 a word (0.4 at most) where no word is common but words of five letters begin alike; 0 below a half otherwise."""
    x, y = name_tokens(a), name_tokens(b)
    if not x or not y:
        return 0.0
    if a.lower() == b.lower():
        return 1.0
    shared = len(x & y) / len(x | y)
    if not shared:
        stems = sum(any(min(len(u), len(v)) >= 5 and (u.startswith(v) or v.startswith(u)) for v in y) for u in x)
        return min(0.3 * stems, 0.4)
    total = min(1.0, shared + (0.1 if type_a.upper() == type_b.upper() else 0.0))
    return round(total, 6) if shared >= 0.5 or total >= 0.5 else 0.0


def column_similarity(spark: SparkSession, tables: dict[str, DataFrame], least: float = 0.5) -> DataFrame:
    """left_table, left_column, right_table, right_column, similarity of column pairs of different tables."""
    columns = [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema]
    rows = []
    for (t, a, x), (u, b, y) in combinations(columns, 2):
        if t != u and (s := name_similarity(a, x, b, y)) >= least:
            rows.append((t, a, u, b, s) if (t, a) < (u, b) else (u, b, t, a, s))
    return spark.createDataFrame(rows, "left_table string, left_column string, right_table string, right_column string, similarity double")


def _keys(spark: SparkSession, tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """t, c, k, n: every distinct key, as text, of the named columns and how many rows have it; one scan per table, one shuffle for all."""
    frames = []
    for t, names in columns.items():
        if names:
            pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("k")) for c in names)))
            frames.append(tables[t].select(F.lit(t).alias("t"), pairs.alias("p")).select("t", "p.c", "p.k"))
    if not frames:
        return spark.createDataFrame([], "t string, c string, k string, n bigint")
    return reduce(DataFrame.unionByName, frames).groupBy("t", "c", "k").agg(F.count("*").alias("n"))


def _facts(keys: DataFrame) -> dict[tuple[str, str], tuple[int, int, int]]:
    """(rows, non-null, distinct) of each column."""
    there = F.col("k").isNotNull()
    rows = keys.groupBy("t", "c").agg(F.sum("n").alias("n"), F.sum(F.when(there, F.col("n")).otherwise(0)).alias("filled"), F.count("k").alias("different")).collect()
    return {(r["t"], r["c"]): (r["n"], r["filled"], r["different"]) for r in rows}


def uniqueness(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> dict[tuple[str, str], tuple[int, int, int]]:
    """(rows, non-null, distinct) of columns, all in one pass; an empty table has zeros."""
    spark = next(iter(tables.values())).sparkSession
    return {(t, c): (0, 0, 0) for t, names in columns.items() for c in names} | _facts(_keys(spark, tables, columns))


def overlap(source: DataFrame, key: str, target: DataFrame, ref: str, sample: int = SAMPLE_KEYS) -> DataFrame:
    """sampled, found: of the smallest distinct keys, how many the other column has. The sample is what the probe asks for; foreign keys are decided by coverages()."""
    keys = source.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(key).alias("o")).distinct().orderBy("o").limit(sample).select("k")
    refs = target.select(F.col(ref).cast("string").alias("k")).join(F.broadcast(keys), "k", "left_semi").distinct().withColumn("hit", F.lit(1))
    return keys.join(refs, "k", "left").agg(F.count("*").alias("sampled"), F.count("hit").alias("found"))


def coverages(keys: DataFrame, pairs: list[tuple[str, str, str, str]]) -> dict[tuple[str, str, str, str], float]:
    """The share of all distinct keys of the first column that the second has, for every pair of columns; one job for all pairs.

    keys: t, c, k of distinct keys; pairs: (table, column, table, column).
    """
    if not pairs:
        return {}
    spark = keys.sparkSession
    sides = [(n, *p[:2], 1) for n, p in enumerate(pairs)] + [(n, *p[2:], 2) for n, p in enumerate(pairs)]
    wanted = spark.createDataFrame(sides, "pair int, t string, c string, side int")  # two rows per pair of columns
    met = keys.where("k is not null").join(F.broadcast(wanted), ["t", "c"]).groupBy("pair", "k").agg(F.bit_or("side").alias("sides"))
    rows = met.groupBy("pair").agg(F.count_if(F.col("sides") != 2).alias("keys"), F.count_if(F.col("sides") == 3).alias("found")).collect()
    shares = {r["pair"]: r["found"] / r["keys"] if r["keys"] else 0.0 for r in rows}
    return {p: shares.get(n, 0.0) for n, p in enumerate(pairs)}


def _joinable(name: str) -> bool:
    bare = re.sub(r"^[a-z]{1,2}_(?=[a-z])", "", name.lower())
    return bool(re.search(r"(?:id|key|no|num|code)$", bare)) or bare.startswith(("link_to_", "fk_"))


def _stem(name: str) -> str:
    bare = re.sub(r"^[a-z]{1,2}_(?=[a-z])", "", name.lower())
    bare = re.sub(r"^(?:link_to_|fk_)", "", bare)
    return re.sub(r"_?(?:id|key|no|num|code)$", "", bare)


def _names_table(stem: str, table: str) -> bool:
    """Whether a column stem stands for a table: the same word, singular or plural, or its shortening (cust for customer)."""
    table = table.lower()
    forms = {table, table.rstrip("s"), re.sub(r"ies$", "y", table)}
    return bool(stem) and (stem in forms or any(len(stem) >= 3 and f.startswith(stem) for f in forms))


def foreign_keys(spark: SparkSession, tables: dict[str, DataFrame], min_overlap: float = 0.9, involving: set[str] | None = None) -> DataFrame:
    """source_table, source_column, target_table, target_column, overlap, cardinality of the foreign keys that names and values agree on.

    A column named after another table (prefix, suffix and shortening aside)
    is tried against that table's own unique key; the referenced side must be
    unique to nine tenths, and of all distinct keys min_overlap must be there. A named candidate
    excludes unnamed ones, which are not tried at all: columns of small
    integers overlap without meaning anything. The distinct keys of all columns
    are counted once and written; facts and overlaps are two aggregates of them.
    involving: only edges that begin or end at one of these tables.
    """
    names = {t: [f.name for f in df.schema if _joinable(f.name)] for t, df in tables.items()}
    # Only tables that some column of another table names are asked for a key, and only columns that may be it are counted.
    wanted = {u: [c for c in names[u] if _names_table(_stem(c), u)] or names[u] for u in tables if any(t != u and (_names_table(_stem(c), u) or c in names[u]) for t in tables for c in names[t])}
    tried = {t: [c for c in cs if any(u != t and (c.lower() in {r.lower() for r in wanted[u]} or _names_table(_stem(c), u)) for u in wanted)] for t, cs in names.items()}
    keys = materialise(_keys(spark, tables, {t: sorted({*wanted.get(t, []), *tried[t]}) for t in tables}))
    facts = _facts(keys)
    fact = lambda t, c: facts.get((t, c), (0, 0, 0))
    primary = {u: c for u, cs in wanted.items() if (c := next((c for c in cs if fact(u, c)[2] >= 0.9 * max(1, fact(u, c)[0])), None))}
    candidates = []
    for t, cs in tried.items():
        for c in cs:
            for u, ref in primary.items():
                same = c.lower() == ref.lower()
                if u == t or not (same or _names_table(_stem(c), u) and _names_table(_stem(ref), u)):
                    continue
                if same and c == primary.get(t) and fact(t, c)[2] > fact(u, ref)[2]:
                    continue  # the larger side is the one referred to
                if involving is None or involving & {t, u}:
                    candidates.append((t, c, u, ref))
    found = {p: share for p, share in coverages(keys, candidates).items() if share >= min_overlap}
    rows = [(*p, round(share, 4), cardinality(fact(*p[:2]), fact(*p[2:]))) for p, share in sorted(found.items())]
    return spark.createDataFrame(rows, "source_table string, source_column string, target_table string, target_column string, overlap double, cardinality string")


def extend_foreign_keys(spark: SparkSession, tables: dict[str, DataFrame], known: DataFrame, new: dict[str, DataFrame]) -> DataFrame:
    """The foreign keys after new tables arrived: known edges stay, and only pairs with a new table are tried."""
    added = {t: df for t, df in new.items() if t not in tables}
    return known.unionByName(foreign_keys(spark, tables | added, involving=set(added))).distinct() if added else known


def cardinality(source: tuple[int, int, int], target: tuple[int, int, int]) -> str:
    one = lambda f: f[2] >= f[1] > 0
    return f"{'one' if one(source) else 'many'}-to-{'one' if one(target) else 'many'}"


def table_roles(spark: SparkSession, tables: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """table_name, row_count, measures, refers_to, referred_by, has_time, role of each table.

    bridge: two references or more and no measure; snapshot: measures and a
    time, few rows; fact: refers to tables and has measures; else dimension.
    """
    links = [tuple(r) for r in edges.select("source_table", "source_column", "target_table", "target_column").distinct().collect()]
    counted = reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t, df in tables.items())) if tables else None
    sizes = {r["t"]: r["n"] for r in counted.collect()} if tables else {}
    rows = []
    for t, df in tables.items():
        used = {c for a, c, _, _ in links if a == t} | {c for _, _, b, c in links if b == t}
        measures = [f.name for f in df.schema if is_numeric(df, f.name) and f.name not in used and not _joinable(f.name)]
        timed = any(isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType) or re.search(r"date|time|year|month", f.name.lower()) for f in df.schema)
        out, into, n = len({c for a, c, _, _ in links if a == t}), len({a for a, _, b, _ in links if b == t}), sizes[t]
        if out >= 2 and not measures:
            role = "bridge"
        elif measures and timed and n < 500:
            role = "snapshot"
        elif out and measures and (timed or not into):
            role = "fact"
        else:
            role = "dimension"
        rows.append((t, n, len(measures), out, into, timed, role))
    return spark.createDataFrame(rows, "table_name string, row_count bigint, measures int, refers_to int, referred_by int, has_time boolean, role string")


def label_column(df: DataFrame) -> str | None:
    """The first text column that looks like a name."""
    texts = [c for c in df.columns if is_text(df, c)]
    return next((c for c in texts if re.search(r"name|title|label|descr", c.lower())), texts[0] if texts else None)


def dimensional_model(spark: SparkSession, tables: dict[str, DataFrame], edges: DataFrame, roles: DataFrame) -> DataFrame:
    """fact_table, dimension, key_column, label of the largest fact and the tables it refers to."""
    facts = sorted(((r["row_count"], r["table_name"]) for r in roles.collect() if r["role"] in ("fact", "snapshot", "bridge")), reverse=True)
    rows = []
    if facts:
        fact = facts[0][1]
        for r in edges.where(F.col("source_table") == fact).orderBy("target_table").collect():
            rows.append((fact, r["target_table"], r["source_column"], label_column(tables[r["target_table"]])))
    return spark.createDataFrame(rows, "fact_table string, dimension string, key_column string, label string")


def members(parents: DataFrame, key: str, label: str, children: DataFrame, ref: str, child_label: str) -> DataFrame:
    """parent, child pairs of a hierarchy, distinct."""
    return parents.select(F.col(key).alias("k"), F.col(label).alias("parent")).join(children.select(F.col(ref).alias("k"), F.col(child_label).alias("child")), "k").select("parent", "child").distinct()
