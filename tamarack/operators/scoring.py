"""Comparing answer tables by the contents of their columns: names and order of rows and columns do not count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that count as empty, lower case.
EMPTY_WORDS = ("", "null", "none", "nan", "nat", "<na>", "n/a", "na")


def normalise_cell(c: Column) -> Column:
    """Empty words as '', numbers to two places (half up), Y-M-D padded, zoned times in UTC, other text trimmed."""
    t = F.trim(c.cast("string"))
    number = t.try_cast("decimal(38,10)")
    day = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    padded = F.concat_ws("-", F.regexp_extract(t, day, 1), F.lpad(F.regexp_extract(t, day, 2), 2, "0"), F.lpad(F.regexp_extract(t, day, 3), 2, "0"))
    zoned = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), F.date_format(t.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    plain = F.round(number, 2).cast("decimal(38,2)")
    return F.when(t.isNull() | F.lower(t).isin(*EMPTY_WORDS), "").when(number.isNotNull(), F.when(plain == 0, F.lit("0.00")).otherwise(plain.cast("string"))).when(t.rlike(day), padded).otherwise(F.coalesce(zoned, t))


def column_signatures(df: DataFrame) -> DataFrame:
    """column_name, signature: a digest of each column's multiset of normalised cells.

    Digests of (value, count) add up, so no column is ever collected: the sum of
    64-bit hashes and the row count stand for the sorted list.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), normalise_cell(F.col(c)).alias("cell")) for c in df.columns)))
    counts = df.select(cells.alias("x")).groupBy("x.column_name", "x.cell").agg(F.count("*").alias("n"))
    digest = lambda seed: F.sum(F.xxhash64("cell", "n", F.lit(seed)).cast("decimal(38,0)")).cast("string")
    got = counts.groupBy("column_name").agg(F.concat_ws(":", F.sum("n").cast("string"), digest(1), digest(2)).alias("signature"))
    every = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column_name string")
    return every.join(F.broadcast(got), "column_name", "left").select("column_name", F.coalesce("signature", F.lit("0")).alias("signature"))


def score_prediction(predicted: DataFrame, gold: DataFrame, penalty: float = 0.2) -> DataFrame:
    """matched, gold_columns, predicted_columns, score: columns matched over gold columns, less penalty for the share of extra ones, 0 at least."""
    a = column_signatures(predicted).groupBy("signature").agg(F.count("*").alias("p"))
    b = column_signatures(gold).groupBy("signature").agg(F.count("*").alias("g"))
    both = a.join(b, "signature", "full_outer").agg(
        F.coalesce(F.sum(F.least(F.coalesce("p", F.lit(0)), F.coalesce("g", F.lit(0)))), F.lit(0)).alias("matched"), F.coalesce(F.sum("g"), F.lit(0)).alias("gold_columns"), F.coalesce(F.sum("p"), F.lit(0)).alias("predicted_columns")
    )
    extra = F.col("predicted_columns") - F.col("matched")
    raw = F.col("matched") / F.greatest(F.col("gold_columns"), F.lit(1)) - penalty * extra / F.greatest(F.col("predicted_columns"), F.lit(1))
    return both.withColumn("score", F.round(F.greatest(F.lit(0.0), raw), 6))


def score_report(scores: DataFrame) -> DataFrame:
    """difficulty, tasks, mean_score, perfect, failed of (difficulty, score)."""
    return scores.groupBy("difficulty").agg(F.count("*").alias("tasks"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("score") >= 1).alias("perfect"), F.count_if(F.col("score") <= 0).alias("failed"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often, in any order."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, duplicates: how many rows repeat another."""
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return counts.agg(F.sum("__n").alias("rows"), F.sum(F.col("__n") - 1).alias("duplicates"))


def positional_match(predicted: DataFrame, gold: DataFrame, order: str, places: int = 6) -> DataFrame:
    """place, contained: whether every gold cell of a row is among the predicted row's cells at the same place of order."""
    cell = lambda c: F.coalesce(F.round(F.trim(c.cast("string")).try_cast("double"), places).cast("string"), F.trim(c.cast("string")), F.lit(""))
    a = predicted.select(F.col(order).alias("place"), F.array(*(cell(F.col(c)) for c in predicted.columns if c != order)).alias("p"))
    b = gold.select(F.col(order).alias("place"), F.array(*(cell(F.col(c)) for c in gold.columns if c != order)).alias("g"))
    return b.join(a, "place", "left").select("place", F.coalesce(F.size(F.array_except("g", "p")) == 0, F.lit(False)).alias("contained"))
