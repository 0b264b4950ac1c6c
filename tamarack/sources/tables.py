"""CSV and JSON tables with the reference types INTEGER, REAL, TEXT, and the sinks."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_ROWS = 50
WRAPPERS = ("records", "data", "items", "results")


def table_name(stem: str) -> str:
    name = re.sub(r"[^A-Za-z0-9_]", "_", stem)
    return f"t_{name}" if name[:1].isdigit() else name


def infer_types(df: DataFrame, rows: int | None = SAMPLE_ROWS) -> dict[str, str]:
    """bigint, double or string for each text column by the first rows, or by all (None); blanks say nothing, a column of blanks is text."""
    sample = df if rows is None else df.limit(rows)
    checks: list[Column] = []
    for i, c in enumerate(df.columns):
        t = F.trim(F.col(f"`{c}`"))
        said = F.coalesce(t != "", F.lit(False))
        checks += [F.count_if(said).alias(f"n{i}"), F.count_if(said & t.try_cast("bigint").isNotNull()).alias(f"i{i}"), F.count_if(said & t.try_cast("double").isNotNull()).alias(f"d{i}")]
    row = sample.agg(*checks).first()
    return {c: "bigint" if row[f"n{i}"] and row[f"i{i}"] == row[f"n{i}"] else "double" if row[f"n{i}"] and row[f"d{i}"] == row[f"n{i}"] else "string" for i, c in enumerate(df.columns)}


def cast_columns(df: DataFrame, types: dict[str, str], keep_raw: bool = False) -> DataFrame:
    """Columns in their types: blanks become null in numbers and stay blank in text; cells that do not parse become null, kept as <name>_raw on request."""
    out = []
    for c in df.columns:
        col, kind = F.col(f"`{c}`"), types.get(c, "string")
        if kind == "string":
            out.append(F.coalesce(col, F.lit("")).alias(c))
            continue
        value = F.trim(col).try_cast(kind)
        out.append(value.alias(c))
        if keep_raw:
            out.append(F.when(value.isNull() & (F.trim(col) != ""), col).alias(f"{c}_raw"))
    return df.select(*out)


def breaks_in_cells(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell of a CSV file may hold a line break: some line has an odd number of quotes. Reads lines, so a large file is split."""
    line = F.col("value")
    return not spark.read.text(path).where((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, keep_raw: bool = False) -> DataFrame:
    """A CSV file with header; short rows are filled with blanks, cells beyond the header dropped. Types come from all rows, so no cell is lost to one.

    A file without line breaks in cells is read in splits; only others are one task each.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", breaks_in_cells(spark, path)).option("escape", '"').csv(path)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    raw = raw.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns))
    return cast_columns(raw, infer_types(raw, None), keep_raw)


def is_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file holds one whole object per line, and more than one of them."""
    first = [r[0].strip() for r in spark.read.text(path).where("trim(value) <> ''").limit(2).collect()]
    return len(first) == 2 and all(x.startswith("{") and x.endswith("}") for x in first)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, an object that wraps one, one flat object, or an object per line (read in splits); nested values become JSON text, booleans 0 and 1."""
    df = spark.read.option("multiLine", not is_json_lines(spark, path)).json(path)
    for w in WRAPPERS:
        if w in df.columns and df.schema[w].dataType.simpleString().startswith("array<struct"):
            df = df.select(F.explode(w).alias("r")).select("r.*")
            break
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        out.append((c.cast("bigint") if kind == "boolean" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c).alias(f.name))
    return df.select(*out)


def primary_key(df: DataFrame) -> str | None:
    """The column that identifies rows: id, *_id, then key-like names, else the first; it must be unique on all rows."""
    ranked = sorted(df.columns, key=lambda c: (0 if c.lower() == "id" else 1 if c.lower().endswith("id") else 2 if re.search(r"key|code|name|identifier|num", c.lower()) else 3, df.columns.index(c)))
    # An estimate in one pass leaves few columns to count exactly, one after the other in the order of their names.
    row = df.agg(F.count("*").alias("n"), *(F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(f"d{i}") for i, c in enumerate(ranked))).first()
    likely = (c for i, c in enumerate(ranked) if row["n"] and row[f"d{i}"] >= 0.85 * row["n"])
    return next((c for c in likely if df.agg(F.count_distinct(F.col(f"`{c}`"))).first()[0] == row["n"]), None)


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; an explicit step, never part of loading."""
    row = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(key).agg(F.max_by(row, F.col(order)).alias("r")).select("r.*")


#: Sinks that pass rows through the driver take so many; larger results belong in df.write.
MOST_DRIVER_ROWS = 1_000_000


def refuse_large(df: DataFrame, most: int | None = None) -> None:
    """Raises where a result has more rows than a sink on the driver takes; reads one row more than allowed."""
    most = MOST_DRIVER_ROWS if most is None else most
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; use df.write")


def write_single_csv(df: DataFrame, path: str) -> int:
    """A small result as one CSV file with header, nulls blank; returns its rows. Larger ones are refused."""
    import csv

    refuse_large(df)
    n = 0
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for r in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
            n += 1
    return n


def write_json(value: object, path: str) -> None:
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, replaced whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
