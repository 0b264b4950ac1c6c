"""Folders of mixed data: what they hold, previews, tasks, and the consolidated catalog."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.sources import tables
from tamarack.sources.sqlite import read_sqlite, sqlite_tables

KINDS = {".csv": "csv", ".json": "json", ".db": "sqlite", ".sqlite": "sqlite", ".parquet": "parquet", ".md": "doc", ".txt": "doc", ".text": "doc"}


def resolve(root: str, relative: str) -> Path:
    """A path below root; paths that lead outside are refused."""
    base = Path(root).resolve()
    path = (base / relative).resolve()
    if base != path and base not in path.parents:
        raise ValueError(f"{relative} leads outside the folder")
    return path


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, kind, bytes, preview of every file of a known kind; preview: the first 500 characters of documents."""
    rows = []
    for p in sorted(Path(root).rglob("*")):
        kind = KINDS.get(p.suffix.lower())
        if kind and p.is_file() and p.name != "task.json":
            kind = "knowledge" if p.name == "knowledge.md" else kind
            preview = p.read_text(errors="replace")[:500] if kind in ("doc", "knowledge") else None
            rows.append((str(p.relative_to(root)), kind, p.stat().st_size, preview))
    return spark.createDataFrame(rows, "path string, kind string, bytes bigint, preview string")


def task_type(inventory: DataFrame) -> str:
    kinds = {r["kind"] for r in inventory.select("kind").distinct().collect()}
    structured, documents = kinds & {"csv", "json", "sqlite", "parquet"}, kinds & {"doc"}
    return "mixed" if structured and documents else "structured_only" if structured else "doc_only"


def tree(root: str, depth: int = 4) -> list[tuple[int, str, bool]]:
    """(level, name, is folder), folders first, to a depth."""
    out: list[tuple[int, str, bool]] = []

    def walk(p: Path, level: int) -> None:
        for x in sorted(p.iterdir(), key=lambda x: (x.is_file(), x.name)):
            out.append((level, x.name, x.is_dir()))
            if x.is_dir() and level + 1 < depth:
                walk(x, level + 1)

    walk(Path(root), 0)
    return out


def consolidate(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every table of a folder, CSV before JSON before SQLite before parquet; the first of a name stays. Registered as temporary views."""
    found: dict[str, DataFrame] = {}
    base = Path(root)

    def add(name: str, df: DataFrame) -> None:
        if name not in found:
            found[name] = df
            df.createOrReplaceTempView(name)

    for p in sorted(base.rglob("*.csv")):
        add(tables.table_name(p.stem), tables.read_csv(spark, str(p)))
    for p in sorted(base.rglob("*.json")):
        if p.name != "task.json":
            add(tables.table_name(p.stem), tables.read_json(spark, str(p)))
    for p in sorted([*base.rglob("*.db"), *base.rglob("*.sqlite")]):
        for t in sqlite_tables(str(p)):
            add(tables.table_name(t), read_sqlite(spark, str(p), t))
    for p in sorted(base.rglob("*.parquet")):
        add(tables.table_name(p.stem), spark.read.parquet(str(p)))
    return found


def csv_preview(spark: SparkSession, path: str, rows: int = 20) -> tuple[list[str], list[list[str]], bool]:
    """(header, first rows, whether there are more)."""
    df = spark.read.option("header", True).csv(path)
    got = df.limit(rows + 1).collect()
    return df.columns, [["" if v is None else v for v in r] for r in got[:rows]], len(got) > rows


def estimated_rows(path: str, lines: int = 100) -> int:
    """Rows of a CSV by its size and the mean length of its first lines."""
    p = Path(path)
    with p.open("rb") as f:
        head = [x for _, x in zip(range(lines + 1), f, strict=False)]
    body = head[1:]
    return round((p.stat().st_size - len(head[0])) / (sum(map(len, body)) / len(body))) if body else 0


def document_window(spark: SparkSession, path: str, chars: int = 4000, offset: int = 0) -> str:
    row = spark.read.text(path, wholetext=True).select(F.substring("value", offset + 1, chars)).first()
    return row[0] if row else ""


#: A larger JSON file is shown as it is written, from its start.
PREVIEW_BYTES = 16 << 20


def json_preview(path: str, chars: int = 4000) -> str:
    """The first characters of a JSON file, indented where it is small enough to be parsed here."""
    p = Path(path)
    if p.stat().st_size > PREVIEW_BYTES:
        with p.open(encoding="utf-8", errors="replace") as f:
            return f.read(chars)
    return json.dumps(json.loads(p.read_text(encoding="utf-8")), indent=2, ensure_ascii=False)[:chars]


def documents(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, path, text of the Markdown and text files below a folder."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt,text}").text(root, wholetext=True)
    return df.select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.input_file_name().alias("path"), F.col("value").alias("text"))


def tasks(spark: SparkSession, root: str, difficulties: list[str] | None = None) -> DataFrame:
    """task_id, difficulty, question of a folder of tasks, by the number in their ids."""
    rows = []
    for p in sorted(Path(root).glob("*/task.json")):
        t = json.loads(p.read_text(encoding="utf-8"))
        if set(t) == {"task_id", "difficulty", "question"}:
            rows.append((t["task_id"], t["difficulty"], t["question"]))
    df = spark.createDataFrame(rows, "task_id string, difficulty string, question string")
    df = df.where(F.col("difficulty").isin(difficulties)) if difficulties else df
    return df.orderBy(F.regexp_extract("task_id", r"(\d+)$", 1).try_cast("int").asc_nulls_first(), "task_id")


def task_counts(task_table: DataFrame) -> DataFrame:
    return task_table.groupBy("difficulty").agg(F.count("*").alias("tasks"), F.sort_array(F.collect_list("task_id")).alias("task_ids"))


def schema_text(found: dict[str, DataFrame]) -> str:
    return "\n".join(f"{t}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)})" for t, df in sorted(found.items()))


def is_plain_name(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_]\w*", name))
