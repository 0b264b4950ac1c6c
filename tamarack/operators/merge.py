"""Merging, de-duplicating and upserting records. All merges are single groupings with combinable aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c.cast("string") != "")


def merge_last_filled(df: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """One row per key: every other column's last value that is neither null nor blank, by order and ties."""
    others = [c for c in df.columns if c not in (key, order, *ties)]
    rank = F.struct(order, *ties)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.max_by(c, F.when(filled(c), rank)).alias(c) for c in others))


def merge_by_confidence(values: DataFrame) -> DataFrame:
    """record, field, value: the first high-confidence value, else the first correction, else the last one.

    values: record, field, value, confidence, is_correction, place. Null values are passed over.
    """
    v = values.where(F.col("value").isNotNull())
    high = F.when(F.lower("confidence") == "high", F.col("place"))
    fixed = F.when(F.coalesce("is_correction", F.lit(False)), F.col("place"))
    picked = v.groupBy("record", "field").agg(F.min_by("value", high).alias("high"), F.min_by("value", fixed).alias("fixed"), F.max_by("value", "place").alias("last"))
    return picked.select("record", "field", F.coalesce("high", "fixed", "last").alias("value"))


def flag_values(values: DataFrame) -> DataFrame:
    """Adds flag: no_value_found, unclear_association (low confidence) or multiple_values; corrections are never flagged."""
    fixed = F.coalesce("is_correction", F.lit(False))
    flag = F.when(fixed, None).when(F.col("value").isNull(), "no_value_found").when(F.lower("confidence") == "low", "unclear_association").when(F.size("alternatives") > 0, "multiple_values")
    return values.withColumn("flag", flag)


def keep_most_filled(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Per key the row with most filled columns; ties go to the first by order. Rows without a key are all kept."""
    count = sum((F.when(filled(c), 1).otherwise(0) for c in df.columns), F.lit(0))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__filled"), *order))
    best = df.where(F.col(key).isNotNull()).withColumn("__filled", count).withColumn("__place", place).where("__place = 1").drop("__filled", "__place")
    return best.unionByName(df.where(F.col(key).isNull()))


def upsert_fill(existing: DataFrame, incoming: DataFrame, key: str, existing_wins: bool = True) -> DataFrame:
    """existing with incoming's rows added and columns evolved; of common cells the existing value stays if it is set (or goes, if not existing_wins).

    Keys are unique on either side; both may lack columns of the other.
    """
    columns = list(dict.fromkeys([*existing.columns, *incoming.columns]))
    a = existing.select(key, *(F.col(c).alias(f"a_{c}") for c in existing.columns if c != key))
    b = incoming.select(key, *(F.col(c).alias(f"b_{c}") for c in incoming.columns if c != key))
    joined = a.join(b, key, "full_outer")

    def cell(c: str) -> Column:
        sides = [f"{s}_{c}" for s, df in (("a", existing), ("b", incoming)) if c in df.columns]
        return F.coalesce(*(F.col(x) for x in (sides if existing_wins else sides[::-1]))).alias(c)

    return joined.select(key, *(cell(c) for c in columns if c != key))


def coverage(df: DataFrame, *ignore: str) -> DataFrame:
    """column_name, coverage: the share of rows with a filled value."""
    columns = [c for c in df.columns if c not in ignore]
    row = df.agg(*(F.avg(F.when(filled(c), 1.0).otherwise(0.0)).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.round(F.col(c), 6).alias("coverage")) for c in columns))).alias("x")).select("x.column_name", "x.coverage")


def drop_rare_columns(df: DataFrame, least: float = 0.1, keep: tuple[str, ...] = ()) -> DataFrame:
    rare = {r["column_name"] for r in coverage(df, *keep).where(F.col("coverage") < least).collect()}
    return df.drop(*rare)


def fill_quantities(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of quantity columns become 0; off unless asked for, as it changes averages."""
    return df.fillna(0, subset=columns)


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates()


def ids_lacking(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, missing of the records that lack expected fields."""
    lacking = F.filter(F.array(*(F.when(~filled(c), F.lit(c)) for c in fields)), lambda x: x.isNotNull())
    return df.select(key, F.array_join(lacking, ",").alias("missing")).where("missing <> ''")


def normalise_ids(df: DataFrame, key: str) -> DataFrame:
    """Strips a text prefix when at least four fifths of the ids are such a prefix and a number, or a number."""
    number = F.regexp_extract(F.col(key), r"^[^0-9]*([0-9]+)$", 1)
    share = df.agg(F.avg(F.when(number != "", 1.0).otherwise(0.0))).first()[0] or 0.0
    return df.withColumn(key, F.when(number != "", number).otherwise(F.col(key))) if share >= 0.8 else df


def best_merge_target(ids: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str]], least: float = 0.5) -> str | None:
    """The table that has more than half of the ids, the one with fewest columns if several do."""
    wanted = ids.select(F.col(key).cast("string").alias("k")).distinct()
    total = wanted.count()
    good = []
    for name, (df, ref) in tables.items():
        hits = wanted.join(df.select(F.col(ref).cast("string").alias("k")), "k", "left_semi").count()
        if total and hits / total > least:
            good.append((len(df.columns), name))
    return min(good)[1] if good else None


def detect_id_key(df: DataFrame, candidates: list[str], least: float = 0.5) -> str | None:
    """The first candidate column that more than half of the rows fill, counted in one pass over all of them."""
    there = [c for c in candidates if c in df.columns]
    if not there:
        return None
    row = df.agg(F.count("*").alias("n"), *(F.count_if(filled(c)).alias(f"k{i}") for i, c in enumerate(there))).first()
    return next((c for i, c in enumerate(there) if row["n"] and row[f"k{i}"] > least * row["n"]), None)


def merge_case_variants(df: DataFrame) -> DataFrame:
    """Columns whose names differ only in case become one, under the first spelling: the first filled value of each row."""
    groups: dict[str, list[int]] = {}
    for i, c in enumerate(df.columns):
        groups.setdefault(c.lower(), []).append(i)
    placed = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    pick = lambda at: F.coalesce(*(F.when(filled(f"c{i}"), F.col(f"c{i}")) for i in at)) if len(at) > 1 else F.col(f"c{at[0]}")
    return placed.select(*(pick(at).alias(df.columns[at[0]]) for at in groups.values()))


def records_table(pieces: DataFrame, key: str, order: str, least: float = 0.1) -> DataFrame:
    """A table of records from pieces: the last filled value of each column, columns filled in less than a tenth of the records dropped, records with nothing but their id left out."""
    merged = merge_last_filled(pieces, key, order)
    kept = drop_rare_columns(merged, least, (key,))
    others = [c for c in kept.columns if c != key]
    return kept.where(reduce(lambda a, b: a | b, (filled(c) for c in others), F.lit(False)))
