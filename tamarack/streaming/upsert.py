"""Entities that arrive in pieces: micro-batches folded into one table, safe to replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.merge import filled
from tamarack.plans.inspect import children


def fold(pieces: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: each column's last filled value by order, with the place it comes from, so that folds of folds agree."""
    columns = [c for c in pieces.columns if c not in (key, order)]
    return pieces.groupBy(key).agg(*(F.max(F.when(filled(c), F.struct(F.col(order).alias("at"), F.col(c).alias("v")))).alias(c) for c in columns))


def combine(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two folds as one; folding a batch twice changes nothing."""
    columns = [c for c in a.columns if c != key]
    return a.unionByName(b).groupBy(key).agg(*(F.max(c).alias(c) for c in columns))


def values(folded: DataFrame, key: str) -> DataFrame:
    return folded.select(key, *(F.col(c)["v"].alias(c) for c in folded.columns if c != key))


def run_upserts(spark: SparkSession, stream: DataFrame, key: str, order: str, folder: str, compact_after: int = 20) -> DataFrame:
    """Folds all that a stream has now into folder and returns the table.

    Each batch writes only its own fold, under its number; a replayed batch
    writes the same fold again. The table is the fold of folds, and folding
    twice changes nothing. After compact_after parts they are written as one,
    under the number of the last of them, and the parts it holds are passed over.
    """
    base = folder.rstrip("/")

    def batch(df: DataFrame, number: int) -> None:
        fold(df, key, order).write.mode("overwrite").parquet(f"{base}/part={number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    named = lambda kind: sorted(int(n.split("=")[1]) for n in children(spark, base) if n.startswith(f"{kind}=") and "_SUCCESS" in children(spark, f"{base}/{n}"))
    whole = named("whole")[-1:]
    parts = [n for n in named("part") if not whole or n > whole[0]]
    folds = [spark.read.parquet(f"{base}/{kind}={n}") for kind, ns in (("whole", whole), ("part", parts)) for n in ns]
    if not folds:
        raise ValueError("the stream had no data")
    table = reduce(lambda a, b: combine(a, b, key), folds) if len(folds) > 1 else folds[0]
    if len(parts) >= compact_after:
        table.write.mode("overwrite").parquet(f"{base}/whole={parts[-1]}")
        table = spark.read.parquet(f"{base}/whole={parts[-1]}")
    return values(table, key)
