"""The schema graph of a set of tables: columns with their facts, values, keys and likenesses, and what is asked of it.

Nodes and edges are DataFrames of metadata; lookups are filters on them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import graph, lookup, profile


@dataclass
class SchemaGraph:
    """columns: table_name, column_name, place, type and the profile; values: table_name and the value index; keys, similar: edges."""

    columns: DataFrame
    values: DataFrame
    keys: DataFrame
    similar: DataFrame

    def table_columns(self, table: str) -> DataFrame:
        return self.columns.where(F.col("table_name") == table)

    def column_values(self, table: str, column: str) -> DataFrame:
        return self.values.where((F.col("table_name") == table) & (F.col("column_name") == column)).select("value", "n")

    def find_value(self, value: str) -> DataFrame:
        """table_name, column_name, value, exact of indexed values equal to a value, or else holding it or held by it."""
        low = F.lit(value.strip().lower())
        exact = F.col("key") == low
        near = F.contains("key", low) | F.contains(low, F.col("key"))
        return self.values.where(exact | near).select("table_name", "column_name", "value", exact.alias("exact"))

    def between(self, a: str, b: str) -> DataFrame:
        """The keys that link two tables, either way."""
        s, t = F.col("source_table"), F.col("target_table")
        return self.keys.where(((s == a) & (t == b)) | ((s == b) & (t == a)))

    def neighbours(self, table: str) -> DataFrame:
        """neighbour, way (refers_to, referred_by, similar) of a table."""
        out = self.keys.where(F.col("source_table") == table).select(F.col("target_table").alias("neighbour"), F.lit("refers_to").alias("way"))
        into = self.keys.where(F.col("target_table") == table).select(F.col("source_table").alias("neighbour"), F.lit("referred_by").alias("way"))
        like = self.similar.where((F.col("left_table") == table) | (F.col("right_table") == table)).select(F.when(F.col("left_table") == table, F.col("right_table")).otherwise(F.col("left_table")).alias("neighbour"), F.lit("similar").alias("way"))
        return out.unionByName(into).unionByName(like).distinct()

    def relationships(self) -> DataFrame:
        """line: every key as "a.x -> b.y (cardinality, overlap)"."""
        return self.keys.select(F.format_string("%s.%s -> %s.%s (%s, %.2f)", "source_table", "source_column", "target_table", "target_column", "cardinality", "overlap").alias("line"))

    def tables_text(self) -> DataFrame:
        """table_name, text: each table on one line with its columns, types and what share of each is filled."""
        c = F.format_string("%s %s %.3f", "column_name", "type", 1 - F.col("null_ratio"))
        return self.columns.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("place", c.alias("c")))).alias("cs")).select("table_name", F.array_join(F.transform("cs", lambda x: x["c"]), ", ").alias("text"))

    def overview(self) -> DataFrame:
        """table_name, row_count, columns, refers_to, referred_by of every table."""
        own = self.columns.groupBy("table_name").agg(F.max("total").alias("row_count"), F.count("*").alias("columns"))
        out = self.keys.groupBy(F.col("source_table").alias("table_name")).agg(F.count_distinct("target_table").alias("refers_to"))
        into = self.keys.groupBy(F.col("target_table").alias("table_name")).agg(F.count_distinct("source_table").alias("referred_by"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        return own.join(out, "table_name", "left").join(into, "table_name", "left").select("table_name", "row_count", "columns", zero("refers_to"), zero("referred_by"))

    def relevant_columns(self, question: str) -> DataFrame:
        """table_name, column_name of the columns whose name matches a word of a question."""
        terms = [w for w in re.findall(r"[a-z]{3,}", question.lower())]
        found = [(r["table_name"], r["column_name"]) for r in self.columns.select("table_name", "column_name").collect() if lookup.term_matches(r["column_name"], terms)]
        return self.columns.sparkSession.createDataFrame(found, "table_name string, column_name string")

    def ontology(self) -> DataFrame:
        """table_name, column_name, semantic_type by name, type and share of distinct values."""
        rows = [(r["table_name"], r["column_name"], lookup.semantic_type(r["column_name"], r["type"], r["cardinality_ratio"])) for r in self.columns.select("table_name", "column_name", "type", "cardinality_ratio").collect()]
        return self.columns.sparkSession.createDataFrame(rows, "table_name string, column_name string, semantic_type string")

    def resolve(self, term: str, aliases: dict[str, str] | None = None, members: DataFrame | None = None) -> DataFrame:
        """how, place, value a term may stand for: an alias, all children of a hierarchy's parent (members: parent, child), an indexed value equal to it or, failing that, near it."""
        spark = self.columns.sparkSession
        low = term.strip().lower()
        known = {a.lower(): v for a, v in (aliases or {}).items()}
        if low in known:
            return spark.createDataFrame([("alias", "", known[low])], "how string, place string, value string")
        if members is not None:
            under = members.where(F.lower("parent") == low).select(F.lit("member").alias("how"), F.lit(term).alias("place"), F.col("child").alias("value"))
            if not under.isEmpty():
                return under
        found = self.find_value(term)
        how = F.when(F.col("exact"), "value").otherwise("near")
        every = found.select(how.alias("how"), F.concat_ws(".", "table_name", "column_name").alias("place"), "value")
        best = every.agg(F.max("how").alias("how"))  # "value" sorts behind "near"
        return every.join(F.broadcast(best), "how").select("how", "place", "value")


def build_graph(spark: SparkSession, tables: dict[str, DataFrame]) -> SchemaGraph:
    """The graph of a set of tables: profile, value index, foreign keys and similar columns."""
    kinds = graph.column_table(spark, tables)
    stats = reduce(DataFrame.unionByName, (profile.column_profile(df).withColumn("table_name", F.lit(t)) for t, df in tables.items()))
    texts = {t: df for t, df in tables.items() if any(profile.is_text(df, c) for c in df.columns)}
    empty = spark.createDataFrame([], "table_name string, column_name string, value string, key string, n bigint, frequency double")
    values = reduce(DataFrame.unionByName, (profile.value_index(df).withColumn("table_name", F.lit(t)) for t, df in texts.items())) if texts else empty
    return SchemaGraph(kinds.join(stats, ["table_name", "column_name"]), values, graph.foreign_keys(spark, tables), graph.column_similarity(spark, tables))


def extend_graph(spark: SparkSession, known: SchemaGraph, tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> SchemaGraph:
    """The graph after new tables arrived: only these are profiled, and only pairs with one of them compared."""
    added = {t: df for t, df in new.items() if t not in tables}
    if not added:
        return known
    own = build_graph(spark, added)
    like = graph.column_similarity(spark, tables | added).where(F.col("left_table").isin(*added) | F.col("right_table").isin(*added))
    return SchemaGraph(known.columns.unionByName(own.columns), known.values.unionByName(own.values), graph.extend_foreign_keys(spark, tables, known.keys, added), known.similar.unionByName(like).distinct())


def consolidated_schema(tables: dict[str, DataFrame], samples: int = 5) -> DataFrame:
    """table_name, column_name, type, row_count, samples (the smallest distinct values, "|" between them), shared: whether another table has a column of the name."""
    spark = next(iter(tables.values())).sparkSession
    sizes = reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t, df in tables.items()))
    rows = []
    for t, df in tables.items():
        counts = profile.value_counts(df).where("value is not null")
        place = F.row_number().over(profile.Window.partitionBy("column_name").orderBy("value"))
        first = counts.withColumn("place", place).where(F.col("place") <= samples).groupBy("column_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "|").alias("samples"))
        rows.append(first.withColumn("table_name", F.lit(t)))
    kinds = graph.column_table(spark, tables)
    names = kinds.groupBy("column_name").agg((F.count_distinct("table_name") > 1).alias("shared"))
    return kinds.join(reduce(DataFrame.unionByName, rows), ["table_name", "column_name"], "left").join(names, "column_name").join(F.broadcast(sizes), "table_name").select("table_name", "column_name", "type", "row_count", F.coalesce("samples", F.lit("")).alias("samples"), "shared")


def column_collisions(columns: DataFrame, question: str) -> DataFrame:
    """column_name, tables of names that several tables have and a word of the question matches."""
    terms = re.findall(r"[a-z]{3,}", question.lower())
    names = [r["column_name"] for r in lookup.ambiguous_columns(columns).collect() if lookup.term_matches(r["column_name"], terms)]
    return lookup.ambiguous_columns(columns).where(F.col("column_name").isin(*names))


def ambiguous_references(spark: SparkSession, sql: str) -> list[str]:
    """Columns that a statement names without saying which of several tables they are of; nothing runs."""
    try:
        spark.sql(sql)
    except AnalysisException as e:
        if e.getCondition() == "AMBIGUOUS_REFERENCE":
            name = (e.getMessageParameters() or {}).get("name", "")
            return [re.sub(r"[`]", "", name)]
    return []


def grounding_faults(spark: SparkSession, plan: dict[str, object], tables: dict[str, DataFrame]) -> list[str]:
    """What is wrong with a grounding {"tables": [...], "columns": ["t.c", ...], "sql": ...}: missing tables and columns, SQL that does not resolve, an empty result."""
    out = [f"no table {t}" for t in plan.get("tables", ()) if t not in tables]
    for place in plan.get("columns", ()):
        t, _, c = str(place).partition(".")
        if t not in tables or c not in tables[t].columns:
            out.append(f"no column {place}")
    if plan.get("sql"):
        try:
            if spark.sql(str(plan["sql"])).isEmpty():
                out.append("no rows")
        except AnalysisException as e:
            out.append(f"does not resolve: {e.getCondition()}")
    return out


def render_grounding(plan: dict[str, object]) -> str:
    """A grounding as lines of "key: values"."""
    return "\n".join(f"{k}: {', '.join(map(str, v)) if isinstance(v, list | tuple) else v}" for k, v in sorted(plan.items()))
