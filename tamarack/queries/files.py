"""Queries of sources and sinks: small tables written as files of every kind and read back."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators import merge
from tamarack.sources import inventory, sqlite, tables
from tamarack.session import load, work_folder

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def folder_of(spark, d: str) -> Path:
    """A folder with the nations as CSV, the regions as wrapped JSON, the suppliers in SQLite, a note, a knowledge file and two tasks."""
    root = Path(re.sub(r"^file:(?://)?", "", work_folder(spark)))
    for part in ("csv", "json", "db", "doc", "tasks/task_2", "tasks/task_10"):
        (root / part).mkdir(parents=True)
    tables.write_single_csv(load(spark, d, "nation"), str(root / "csv/nation.csv"))
    tables.write_json({"records": [r.asDict() for r in load(spark, d, "region").collect()]}, str(root / "json/region.json"))
    sqlite.write_sqlite(load(spark, d, "supplier"), str(root / "db/data.db"), "supplier", key="s_suppkey")
    (root / "doc/note.md").write_text("## Head\n\nhello")
    (root / "knowledge.md").write_text("- **Glucose (numeric):** sugar")
    for n, level in ((10, "easy"), (2, "hard")):
        tables.write_json({"task_id": f"task_{n}", "difficulty": level, "question": "?"}, str(root / f"tasks/task_{n}/task.json"))
    return root


@query("files_inventory", "SELECT * FROM (VALUES ('csv/nation.csv', 'csv'), ('json/region.json', 'json'), ('db/data.db', 'sqlite'), ('doc/note.md', 'doc'), ('knowledge.md', 'knowledge')) t(path, kind)")
def _(spark, d):
    return inventory.scan(spark, str(folder_of(spark, d))).select("path", "kind")


@query("files_task_type", "SELECT 'mixed' AS whole, 'structured_only' AS tables_only, 'doc_only' AS documents_only")
def _(spark, d):
    found = inventory.scan(spark, str(folder_of(spark, d)))
    kinds = [inventory.task_type(found.where(c)) for c in ("true", "kind in ('csv', 'json')", "kind in ('doc', 'knowledge')")]
    return spark.createDataFrame([tuple(kinds)], "whole string, tables_only string, documents_only string")


@query("files_tree", "SELECT * FROM (VALUES (0, 'csv'), (1, 'nation.csv'), (0, 'db'), (1, 'data.db'), (0, 'doc'), (1, 'note.md'), (0, 'json'), (1, 'region.json'), (0, 'knowledge.md'), (0, 'tasks'), (1, 'task_2'), (1, 'task_10')) t(level, name)")
def _(spark, d):
    return spark.createDataFrame([(level, n) for level, n, _ in inventory.tree(str(folder_of(spark, d)), 2)], "level int, name string")


@query("files_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    return tables.read_csv(spark, str(folder_of(spark, d) / "csv/nation.csv"))


@query("files_csv_types", "SELECT * FROM (VALUES ('n_nationkey', 'bigint'), ('n_name', 'string'), ('n_regionkey', 'bigint')) t(column_name, type)")
def _(spark, d):
    df = tables.read_csv(spark, str(folder_of(spark, d) / "csv/nation.csv"))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "column_name string, type string")


@query("files_ragged_csv", "SELECT * FROM (VALUES (1, '2', 'a'), (2, '', ''), (3, 'x', ''), (4, '5', 'b'), (5, 'two' || chr(10) || 'lines', 'c')) t(id, n, v)")
def _(spark, d):
    """Short and long rows, a blank, a text among numbers, a line break in a cell."""
    path = folder_of(spark, d) / "csv/ragged.csv"
    path.write_text('id, n,v\n1,2,a\n2,,\n3,x\n4,5,b,extra\n5,"two\nlines",c\n')
    return tables.read_csv(spark, str(path))


@query("files_cast_cells", "SELECT lab_id, CASE WHEN regexp_full_match(trim(id), '[-+]?[0-9]+') THEN CAST(trim(id) AS BIGINT) END AS id, CASE WHEN NOT regexp_full_match(trim(id), '[-+]?[0-9]+') AND trim(id) <> '' THEN id END AS id_raw FROM laboratory")
def _(spark, d):
    lab = load(spark, d, "laboratory").select(F.col("lab_id").cast("string").alias("lab_id"), "id")
    return tables.cast_columns(lab, {"lab_id": "bigint", "id": "bigint"}, keep_raw=True).select("lab_id", "id", "id_raw")


@query("files_inferred_types", "SELECT 'lab_id' AS column_name, 'bigint' AS type UNION ALL SELECT 'glu', 'double' UNION ALL SELECT 'id', CASE WHEN (SELECT count(*) FILTER (trim(id) <> '' AND TRY_CAST(trim(id) AS BIGINT) IS NULL) FROM laboratory) > 0 THEN 'string' ELSE 'bigint' END")
def _(spark, d):
    lab = load(spark, d, "laboratory").select(*(F.col(c).cast("string").alias(c) for c in ("lab_id", "glu", "id")))
    return spark.createDataFrame(sorted(tables.infer_types(lab, None).items()), "column_name string, type string")


@query("files_primary_keys", "SELECT * FROM (VALUES ('laboratory', 'lab_id'), ('customer', 'c_custkey'), ('lineitem', NULL)) t(table_name, key)")
def _(spark, d):
    found = {t: tables.primary_key(load(spark, d, t)) for t in ("laboratory", "customer")}
    found["lineitem"] = tables.primary_key(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))
    return spark.createDataFrame(list(found.items()), "table_name string, key string")


@query("files_json", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return tables.read_json(spark, str(folder_of(spark, d) / "json/region.json"))


@query("files_json_lines", "SELECT n_nationkey, n_name, n_nationkey % 2 AS odd, '{\"k\":' || n_regionkey || '}' AS nested FROM nation")
def _(spark, d):
    path = folder_of(spark, d) / "json/lines.json"
    path.write_text("\n".join(json.dumps({"n_nationkey": r["n_nationkey"], "n_name": r["n_name"], "odd": r["n_nationkey"] % 2 == 1, "nested": {"k": r["n_regionkey"]}}) for r in load(spark, d, "nation").collect()))
    return tables.read_json(spark, str(path))


@query("files_sqlite", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, d):
    return sqlite.read_sqlite(spark, str(folder_of(spark, d) / "db/data.db"), "supplier")


@query("files_sqlite_tables", "SELECT 'supplier' AS table_name, true AS has_key")
def _(spark, d):
    path = str(folder_of(spark, d) / "db/data.db")
    ddl = dict(sqlite.sqlite_schema(path))
    return spark.createDataFrame([(t, "PRIMARY KEY" in ddl[t]) for t in sqlite.sqlite_tables(path)], "table_name string, has_key boolean")


@query("files_sqlite_merged", "SELECT 'supplier' AS table_name, count(*) AS n FROM supplier UNION ALL SELECT 'supplier_doc', 5 UNION ALL SELECT 'extracted', count(DISTINCT n_regionkey) FROM nation")
def _(spark, d):
    """A protected table stays and the rows go beside it; rows of one key replace each other."""
    path = str(folder_of(spark, d) / "db/data.db")
    sqlite.write_sqlite(load(spark, d, "region"), path, "supplier", key="r_regionkey", protected=frozenset({"Supplier"}))
    sqlite.write_sqlite(load(spark, d, "nation").select("n_regionkey", "n_name"), path, "extracted", key="n_regionkey")
    return spark.createDataFrame([(t, sqlite.read_sqlite(spark, path, t).count()) for t in sqlite.sqlite_tables(path)], "table_name string, n bigint")


@query("files_catalog", "SELECT 'nation' AS table_name, count(*) AS n, 3 AS columns FROM nation UNION ALL SELECT 'region', count(*), 2 FROM region UNION ALL SELECT 'supplier', count(*), 4 FROM supplier")
def _(spark, d):
    found = inventory.consolidate(spark, str(folder_of(spark, d)))
    return spark.createDataFrame([(t, df.count(), len(df.columns)) for t, df in found.items()], "table_name string, n bigint, columns int")


@query("files_table_names", "SELECT regexp_replace(CASE WHEN regexp_matches(source, '^[0-9]') THEN 't_' || source ELSE source END, '[^A-Za-z0-9_]', '_', 'g') AS name FROM (SELECT DISTINCT source FROM mix_target WHERE source IS NOT NULL UNION SELECT '1 odd-name.x')")
def _(spark, d):
    names = [r[0] for r in load(spark, d, "mix_target").select("source").where("source is not null").distinct().collect()]
    return spark.createDataFrame([(tables.table_name(n),) for n in [*names, "1 odd-name.x"]], "name string")


@query("files_paths", "SELECT * FROM (VALUES ('csv/nation.csv', true), ('../x', false), ('csv/../../x', false), ('/etc/passwd', false)) t(path, inside)")
def _(spark, d):
    root, out = str(folder_of(spark, d)), []
    for p in ("csv/nation.csv", "../x", "csv/../../x", "/etc/passwd"):
        try:
            inventory.resolve(root, p)
            out.append((p, True))
        except ValueError:
            out.append((p, False))
    return spark.createDataFrame(out, "path string, inside boolean")


@query("files_csv_preview", "SELECT n_nationkey AS k, true AS more FROM nation ORDER BY n_nationkey LIMIT 3")
def _(spark, d):
    path = folder_of(spark, d) / "csv/sorted.csv"
    tables.write_single_csv(load(spark, d, "nation").orderBy("n_nationkey").coalesce(1), str(path))
    _, rows, more = inventory.csv_preview(spark, str(path), 3)
    return spark.createDataFrame([(int(r[0]), more) for r in rows], "k int, more boolean")


@query("files_estimated_rows", "SELECT count(*) BETWEEN 20 AND 30 AS near FROM nation")
def _(spark, d):
    n = inventory.estimated_rows(str(folder_of(spark, d) / "csv/nation.csv"))
    return spark.createDataFrame([(20 <= n <= 30,)], "near boolean")


@query("files_previews", "SELECT 'Head' AS part, 3 AS offset_chars UNION ALL SELECT '{' || chr(10) || '  \"', 0")
def _(spark, d):
    root = folder_of(spark, d)
    return spark.createDataFrame([(inventory.document_window(spark, str(root / "doc/note.md"), 4, 3), 3), (inventory.json_preview(str(root / "json/region.json"), 5), 0)], "part string, offset_chars int")


@query("files_tasks", "SELECT * FROM (VALUES (1, 'task_2', 'hard'), (2, 'task_10', 'easy')) t(place, task_id, difficulty)")
def _(spark, d):
    got = inventory.tasks(spark, str(folder_of(spark, d) / "tasks")).collect()
    return spark.createDataFrame([(k + 1, r["task_id"], r["difficulty"]) for k, r in enumerate(got)], "place int, task_id string, difficulty string")


@query("files_task_counts", "SELECT * FROM (VALUES ('easy', 1, 'task_10'), ('hard', 1, 'task_2')) t(difficulty, tasks, ids)")
def _(spark, d):
    return inventory.task_counts(inventory.tasks(spark, str(folder_of(spark, d) / "tasks"))).select("difficulty", "tasks", F.array_join("task_ids", ",").alias("ids"))


@query("files_summary", "SELECT difficulty, count(*) AS tasks FROM eval_item WHERE difficulty IS NOT NULL GROUP BY difficulty")
def _(spark, d):
    """A summary written as JSON by the driver and read again."""
    path = folder_of(spark, d) / "summary.json"
    counts = load(spark, d, "eval_item").where("difficulty is not null").groupBy("difficulty").agg(F.count("*").alias("tasks"))
    tables.write_json([r.asDict() for r in counts.collect()], str(path))
    return tables.read_json(spark, str(path)).select("difficulty", "tasks")


@query("files_new_table", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    """Columns filled in less than a tenth of the rows do not get into a new table."""
    n = load(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") == 3, "x").alias("rare"))
    path = f"{work_folder(spark)}/nation"
    tables.write_table(merge.drop_rare_columns(n), path)
    return spark.read.parquet(path)


@query("files_table_copy", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    path = f"{work_folder(spark)}/region"
    tables.write_table(load(spark, d, "region"), path, ["r_regionkey"])
    return spark.read.parquet(path).select("r_regionkey", "r_name")


@query("files_documents", "SELECT 'hello' AS last_words, 14 AS chars")
def _(spark, d):
    docs: DataFrame = inventory.documents(spark, str(folder_of(spark, d) / "doc"))
    return docs.select(F.regexp_extract("text", r"(\w+)\s*$", 1).alias("last_words"), F.length("text").alias("chars"))
