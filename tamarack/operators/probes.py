"""Counting probes on filters, entities and joins. Several probes of one table share one aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predicate(column: str, op: str, value) -> Column:
    """A Column for the filters a plan can hold: = != <> < <= > >= LIKE IN BETWEEN IS NOT NULL."""
    c, op = F.col(column), op.upper().strip()
    if op == "IS NOT NULL":
        return c.isNotNull()
    if op == "IS NULL":
        return c.isNull()
    if op == "LIKE":
        return F.lower(c).like(str(value).lower())
    if op == "IN":
        return c.isin(*value)
    if op == "BETWEEN":
        return c.between(*value)
    return {"=": c == value, "!=": c != value, "<>": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def count_matching(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """probe, n: how many rows meet each condition, in one pass."""
    row = df.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("probe"), F.col(n).alias("n")) for n in conditions))).alias("x")).select("x.probe", "x.n")


def count_entities(df: DataFrame, entity: str, condition: Column) -> DataFrame:
    return df.where(condition).agg(F.count_distinct(entity).alias("entities"))


def drop_one(df: DataFrame, entity: str, conditions: dict[str, Column]) -> DataFrame:
    """dropped, entities: distinct entities with all conditions ('' dropped) and with each left out.

    One row per entity records which combinations it meets, so there is one
    shuffle whatever the number of conditions.
    """
    names = list(conditions)
    tests = {"": all_of(list(conditions.values()))} | {n: all_of([c for m, c in conditions.items() if m != n]) for n in names}
    per = df.groupBy(entity).agg(*(F.max(F.coalesce(t, F.lit(False))).alias(f"k{i}") for i, t in enumerate(tests.values()))).where(F.col(entity).isNotNull())
    row = per.agg(*(F.count_if(F.col(f"k{i}")).alias(f"k{i}") for i in range(len(tests))))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("dropped"), F.col(f"k{i}").alias("entities")) for i, n in enumerate(tests)))).alias("x")).select("x.dropped", "x.entities")


def vacuous_filters(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """filter, with_filter, without_filter, vacuous: whether a conjunct changes the count of the others."""
    whole = all_of(list(conditions.values()))
    aggregates = [F.count_if(whole).alias("all")] + [F.count_if(all_of([c for m, c in conditions.items() if m != n])).alias(n) for n in conditions]
    row = df.agg(*aggregates)
    x = row.select("all", F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), F.col(n).alias("without_filter")) for n in conditions))).alias("x"))
    return x.select("x.filter", F.col("all").alias("with_filter"), "x.without_filter", ((F.col("all") == F.col("x.without_filter")) & (F.col("all") > 1)).alias("vacuous"))


def rows_per_entity(df: DataFrame, entity: str) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), F.count_distinct(entity).alias("entities")).select("row_count", "entities", F.round(F.col("row_count") / F.greatest(F.col("entities"), F.lit(1)), 6).alias("rows_per_entity"))


def co_occurrence(df: DataFrame, entity: str, a: Column, b: Column) -> DataFrame:
    """same_row, across_rows: entities that meet both conditions in one row, and in any rows."""
    yes = lambda c: F.max(F.coalesce(c, F.lit(False)))
    per = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(yes(a & b).alias("both"), yes(a).alias("a"), yes(b).alias("b"))
    return per.agg(F.count_if("both").alias("same_row"), F.count_if(F.col("a") & F.col("b")).alias("across_rows"))


def entities_with_all(df: DataFrame, entity: str, conditions: list[Column]) -> DataFrame:
    """Entities for which each condition holds in some row: one grouping instead of a semi-join per condition."""
    per = df.groupBy(entity).agg(*(F.max(F.coalesce(c, F.lit(False))).alias(f"k{i}") for i, c in enumerate(conditions)))
    return per.where(all_of([F.col(f"k{i}") for i in range(len(conditions))]) & F.col(entity).isNotNull()).select(entity)


def join_fan_out(source: DataFrame, key: str, target: DataFrame, ref: str) -> DataFrame:
    """source_rows, joined_rows, fan_out of an inner join, from key counts: the join itself is not made."""
    a = source.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("a"))
    b = target.groupBy(F.col(ref).alias("k")).agg(F.count("*").alias("b"))
    # Nulls match nothing; counts per key are unique on either side.
    row = a.join(b, "k", "left").agg(F.sum("a").alias("source_rows"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("joined_rows"))
    return row.withColumn("fan_out", F.round(F.col("joined_rows") / F.greatest(F.col("source_rows"), F.lit(1)), 6))


def latest(df: DataFrame, entity: str, at: str) -> DataFrame:
    """Each entity's rows of its latest time, ties kept."""
    last = df.groupBy(entity).agg(F.max(at).alias("__last"))
    return df.join(last, entity).where(F.col(at) == F.col("__last")).drop("__last")


def first_and_last(df: DataFrame, entity: str, at: str, value: str, *ties: str) -> DataFrame:
    """first_value and last_value of each entity over rows that have a value; ties by further columns."""
    order = F.struct(at, *ties)
    return df.where(F.col(value).isNotNull()).groupBy(entity).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))


def extremes_with_ties(df: DataFrame, column: str, largest: bool = True) -> DataFrame:
    """All rows that hold the extreme; the extreme is one row and is broadcast."""
    edge = df.agg((F.max if largest else F.min)(column).alias("__edge"))
    return df.join(F.broadcast(edge), F.col(column) == F.col("__edge")).drop("__edge")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The feature is the limit: k rows by a total order."""
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)
