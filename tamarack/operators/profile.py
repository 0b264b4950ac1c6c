"""Column profiles, value counts, order statistics and distributions.

Everything per column comes from two passes: one aggregate for numeric extremes,
and one count per (column, value), whose partial aggregation keeps frequent
values from being shuffled row by row. There is no global window: order
statistics find their places from counts in ranges of values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.session import materialise, spread


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value (as text), n for every distinct value, null included."""
    columns = columns or df.columns
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.column_name", "p.value").agg(F.count("*").alias("n"))


def hashed_counts(df: DataFrame) -> DataFrame:
    """column_name, a, b, n: value_counts() with 128 bits of hash for each value, so that long texts stay where they are; null has no hash."""
    h = lambda c, seed: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(seed), F.col(c).cast("string")))
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), h(c, 1).alias("a"), h(c, 2).alias("b")) for i, c in enumerate(df.columns))))
    names = F.array(*(F.lit(c) for c in df.columns))
    return spread(df).select(pairs.alias("p")).groupBy("p.c", "p.a", "p.b").agg(F.count("*").alias("n")).select(names[F.col("c")].alias("column_name"), "a", "b", "n")


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: total, non_null, distinct_count, null_ratio (3 places), cardinality_ratio (4) and, for numbers, min_value, max_value, avg_value (2).

    An empty table gives ratios of 0 and null extremes. Nulls are no values.
    """
    counts = hashed_counts(df).groupBy("column_name").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("a").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"), F.count("a").alias("distinct_count")
    )
    numbers = [c for c in df.columns if is_numeric(df, c)]
    spark = df.sparkSession
    if numbers:
        stats = df.agg(*(F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.avg(c).alias("mean")).alias(c) for c in numbers))
        extremes = stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in numbers))).alias("e"))
        extremes = extremes.select("e.column_name", F.col("e.s.lo").alias("min_value"), F.col("e.s.hi").alias("max_value"), F.round("e.s.mean", 2).alias("avg_value"))
    else:
        extremes = spark.createDataFrame([], "column_name string, min_value double, max_value double, avg_value double")
    every = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    # One row per column on either side.
    joined = every.join(F.broadcast(counts), "column_name", "left").join(F.broadcast(extremes), "column_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    # Rounded half up from whole numbers, so that a tie does not depend on its binary form.
    ratio = lambda a, b, places: F.when(b > 0, F.floor((a * (2 * 10**places) + b) / (2 * b)) / 10**places).otherwise(0.0)
    joined = joined.withColumns({c: zero(c) for c in ("total", "non_null", "distinct_count")})
    return joined.select(
        "column_name", "total", "non_null", "distinct_count", ratio(F.col("total") - F.col("non_null"), F.col("total"), 3).alias("null_ratio"), ratio(F.col("distinct_count"), F.col("total"), 4).alias("cardinality_ratio"), "min_value", "max_value", "avg_value"
    )


def value_index(df: DataFrame, most_distinct: int = 500, top: int = 200) -> DataFrame:
    """column_name, value, key (lower case, trimmed), n, frequency: the commonest values of text columns with at most most_distinct of them.

    Blank and null values are not indexed; ties go to the smaller value.
    """
    texts = [c for c in df.columns if is_text(df, c)]
    counts = value_counts(df, texts).where("value is not null and trim(value) <> ''")
    sizes = counts.groupBy("column_name").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("all")).where(F.col("distinct_values").between(1, most_distinct))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    kept = counts.join(F.broadcast(sizes), "column_name").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return kept.select("column_name", "value", F.lower(F.trim("value")).alias("key"), "n", F.round(F.col("n") / F.col("all"), 6).alias("frequency"))


def modes(df: DataFrame, most_distinct: int = 200) -> DataFrame:
    """column_name, mode, n, frequency over non-null rows, for text columns of at most most_distinct values; ties go to the smaller value."""
    texts = [c for c in df.columns if is_text(df, c)]
    counts = value_counts(df, texts).where("value is not null")
    best = counts.groupBy("column_name").agg(F.count("*").alias("d"), F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("best")).where(F.col("d") <= most_distinct)
    return best.select("column_name", F.col("best.value").alias("mode"), (-F.col("best.less")).alias("n"), F.round(-F.col("best.less") / F.col("all"), 6).alias("frequency"))


def order_statistics(df: DataFrame, column: str, index_of) -> dict[str, float]:
    """Values at places of the ascending non-null values; index_of(n) names the places from the number of values.

    Counts per value are laid out in ranges; sums of the ranges tell which range
    holds a place, and only within it are the counts added up.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranged = materialise(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    parts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    places: dict[str, int] = index_of(sum(parts.values()))
    if not places:
        return {}
    offsets, total = [], 0
    for part in sorted(parts):
        offsets.append((part, total))
        total += parts[part]
    small = df.sparkSession.createDataFrame(offsets or [(0, 0)], "part int, offset long")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("upto", upto).join(F.broadcast(small), "part").withColumn("last", F.col("offset") + F.col("upto")).withColumn("first", F.col("last") - F.col("n"))
    hit = reduce(lambda a, b: a | b, ((F.col("first") <= i) & (F.col("last") > i) for i in set(places.values())))
    found = [(r["first"], r["last"], r["v"]) for r in placed.where(hit).collect()]
    return {name: next(v for a, b, v in found if a <= i < b) for name, i in places.items()}


def profile_quartiles(df: DataFrame, column: str) -> dict[str, float]:
    """p25, p75 at places n // 4 - 1 and 3n // 4 - 1 (0 at least), for four values or more, to 2 places."""
    got = order_statistics(df, column, lambda n: {"p25": max(0, n // 4 - 1), "p75": max(0, 3 * n // 4 - 1)} if n >= 4 else {})
    return {k: round(v, 2) for k, v in got.items()}


def range_percentiles(df: DataFrame, column: str, points=(5, 25, 50, 75, 95)) -> dict[str, float]:
    """Values at places int(n p) - 1 (0 at least), for ten values or more."""
    return order_statistics(df, column, lambda n: {f"p{p}": max(n * p // 100 - 1, 0) for p in points} if n >= 10 else {})


def floor_percentiles(df: DataFrame, column: str, points=(10, 25, 50, 75, 90)) -> dict[str, float]:
    """Values at places int(n p / 100), within 0 and n - 1."""
    return order_statistics(df, column, lambda n: {f"p{p}": min(max(n * p // 100, 0), n - 1) for p in points} if n else {})


def histogram(df: DataFrame, column: str, buckets: int = 5) -> DataFrame:
    """bucket, low, high, n of equal widths; half open, the last one closed. All equal values fall into the first; empty buckets are left out."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bucket int, low double, high double, n bigint")
    width = (high - low) / buckets or 1.0
    bucket = F.least(F.floor((F.col(column) - low) / width), F.lit(buckets - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).select("bucket", (F.lit(low) + F.col("bucket") * width).alias("low"), (F.lit(low) + (F.col("bucket") + 1) * width).alias("high"), "n")


def fences(quartiles: dict[str, float]) -> tuple[float, float]:
    """The usual range from percentiles p5..p95: quartiles widened by 1.5 times their distance, to 4 places; p5 to p95 when that is 0."""
    spread = quartiles["p75"] - quartiles["p25"]
    low, high = (quartiles["p25"] - 1.5 * spread, quartiles["p75"] + 1.5 * spread) if spread else (quartiles["p5"], quartiles["p95"])
    return round(low, 4), round(high, 4)


def approximate_fences(low: float, high: float, mean: float) -> tuple[float, float]:
    """Fences without order statistics: a quarter of the range stands for the quartile distance, the mean for the middle."""
    quarter = (high - low) / 4
    return mean - 2.5 * quarter, mean + 2.5 * quarter


def linear_percentile(low: float, high: float, percent: float, top: bool = True) -> float:
    """The threshold of the top (or bottom) percent if values lay evenly between the extremes, to 2 places."""
    part = percent / 100
    return round(low + (high - low) * (1 - part if top else part), 2)


def extremes(df: DataFrame, column: str) -> tuple[float | None, float | None, float | None]:
    """(least, largest, mean) of a column in one pass; None without values."""
    row = df.agg(F.min(column).cast("double"), F.max(column).cast("double"), F.avg(column)).first()
    return row[0], row[1], row[2]


def null_shares(df: DataFrame, sparse: float = 0.7) -> DataFrame:
    """column_name, filled, null_ratio (4 places), sparse: how many rows have a value, and whether most have none; an empty table has ratio 0."""
    row = df.agg(F.count("*").alias("__rows"), *(F.count(c).alias(c) for c in df.columns))
    x = row.select("__rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in df.columns))).alias("x"))
    ratio = F.when(F.col("__rows") > 0, 1 - F.col("x.filled") / F.col("__rows")).otherwise(0.0)
    return x.select("x.column_name", "x.filled", F.round(ratio, 4).alias("null_ratio"), (ratio > sparse).alias("sparse"))


def range_validation(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """inside, below, above, useful: useful when 5 % < inside < 99 % and something lies outside."""
    c = F.col(column)
    row = df.agg(F.count_if((c >= low) & (c <= high)).alias("inside"), F.count_if(c < low).alias("below"), F.count_if(c > high).alias("above"))
    share = F.col("inside") / F.greatest(F.col("inside") + F.col("below") + F.col("above"), F.lit(1))
    return row.withColumn("useful", (share > 0.05) & (share < 0.99) & (F.col("below") + F.col("above") > 0))


def null_like_ratios(df: DataFrame, limit: float = 0.8) -> DataFrame:
    """column_name, ratio, warned: the share of nulls, blanks and zeros in each column of a result."""
    empty = lambda c: F.when(F.col(c).isNull() | (F.col(c).cast("string") == "") | F.coalesce(F.col(c).cast("string").try_cast("double") == 0, F.lit(False)), 1.0).otherwise(0.0)
    row = df.agg(F.count("*").alias("__rows"), *(F.avg(empty(c)).alias(c) for c in df.columns))
    return row.select("__rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.round(F.col(c), 4).alias("ratio")) for c in df.columns))).alias("x")).select("x.column_name", "x.ratio", ((F.col("__rows") > 5) & (F.col("x.ratio") > limit)).alias("warned"))


def value_spread(df: DataFrame, column: str) -> DataFrame:
    """spread (max - min over |avg|) and its kind: tight under 1, wide over 5, else moderate; unknown without an average."""
    row = df.agg((F.max(column) - F.min(column)).alias("reach"), F.avg(column).alias("mean"))
    spread = F.when(F.col("mean") != 0, F.col("reach") / F.abs("mean"))
    return row.select(F.round(spread, 6).alias("spread"), F.when(spread.isNull(), "unknown").when(spread < 1, "tight").when(spread > 5, "wide").otherwise("moderate").alias("kind"))


def share_where(condition: Column) -> Column:
    """The percentage of rows that meet a condition."""
    return F.round(100.0 * F.count_if(condition) / F.count("*"), 6)
