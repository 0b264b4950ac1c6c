import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tamarack.sources import inventory, sqlite, tables
from tamarack.streaming import upsert


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "json").mkdir()
    (tmp_path / "db").mkdir()
    (tmp_path / "doc").mkdir()
    (tmp_path / "csv" / "1 ragged.csv").write_text("id, n,v\n1,2,a\n2,,\n3,x\n4,5,b,extra\n")
    (tmp_path / "json" / "wrapped.json").write_text(json.dumps({"records": [{"a": 1, "b": True, "c": {"d": 1}}, {"a": 2.5, "b": None, "c": None}]}))
    (tmp_path / "json" / "flat.json").write_text(json.dumps({"x": 1, "y": "z"}))
    with sqlite3.connect(tmp_path / "db" / "data.db") as c:
        c.execute("CREATE TABLE people (id INTEGER PRIMARY KEY, name TEXT, size REAL)")
        c.executemany("INSERT INTO people VALUES (?, ?, ?)", [(1, "A", 1.5), (2, None, None), (30, "C", "tall")])
        c.execute("CREATE TABLE bare (x TEXT)")
    (tmp_path / "doc" / "note.md").write_text("## Head\nhello")
    (tmp_path / "knowledge.md").write_text("- **Glucose (numeric):** sugar")
    return tmp_path


def test_consolidate(spark, folder):
    found = inventory.consolidate(spark, str(folder))
    assert set(found) == {"t_1_ragged", "flat", "wrapped", "people", "bare"}
    ragged = found["t_1_ragged"]
    assert [f.dataType.simpleString() for f in ragged.schema] == ["bigint", "string", "string"]
    assert [tuple(r) for r in ragged.orderBy("id").collect()] == [(1, "2", "a"), (2, "", ""), (3, "x", ""), (4, "5", "b")]
    assert sorted((r["a"], r["b"]) for r in found["wrapped"].collect() if r["b"] is not None) == [(1.0, 1)]
    assert json.loads(found["wrapped"].where("a = 1").first()["c"]) == {"d": 1}
    assert sorted((r["id"], r["size"]) for r in found["people"].collect()) == [(1, 1.5), (2, None), (30, None)]
    assert found["bare"].count() == 0
    assert "people(id bigint" in inventory.schema_text(found)


def test_csv_keeps_late_text(spark, tmp_path):
    (tmp_path / "late.csv").write_text("n,code,size\n" + "".join(f"{i},{i},{i}\n" for i in range(60)) + "60,A7,1.5\n61,,\n")
    late = inventory.consolidate(spark, str(tmp_path))["late"]
    assert [f.dataType.simpleString() for f in late.schema] == ["bigint", "string", "double"]
    assert [tuple(r) for r in late.where("n in (7, 60, 61)").orderBy("n").collect()] == [(7, "7", 7.0), (60, "A7", 1.5), (61, "", None)]


def test_inventory(spark, folder):
    scan = inventory.scan(spark, str(folder))
    assert inventory.task_type(scan) == "mixed"
    assert {r["kind"] for r in scan.collect()} == {"csv", "json", "sqlite", "doc", "knowledge"}
    with pytest.raises(ValueError):
        inventory.resolve(str(folder), "../x")
    header, rows, more = inventory.csv_preview(spark, str(folder / "csv" / "1 ragged.csv"), 2)
    assert len(rows) == 2 and more
    assert inventory.document_window(spark, str(folder / "doc" / "note.md"), 4, 3) == "Head"
    assert inventory.estimated_rows(str(folder / "csv" / "1 ragged.csv")) == 4
    assert inventory.documents(spark, str(folder / "doc")).count() == 1
    assert ("csv" in [n for _, n, _ in inventory.tree(str(folder))]) and inventory.json_preview(str(folder / "json" / "flat.json"), 5)
    assert sqlite.sqlite_schema(str(folder / "db" / "data.db"))[0][0] == "bare"


def test_types_keep_raw_cells(spark):
    df = spark.createDataFrame([(str(i), "") for i in range(60)] + [("oops", "")], "n string, b string").coalesce(1)
    types = tables.infer_types(df)
    assert types == {"n": "bigint", "b": "string"}
    cast = tables.cast_columns(df, types, keep_raw=True)
    assert [r["n_raw"] for r in cast.where("n_raw is not null").collect()] == ["oops"]
    assert tables.primary_key(df.select("n")) == "n" and tables.primary_key(df.select("b")) is None
    assert tables.keep_last(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, at int, v string"), "k", "at").first()["v"] == "b"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, 2.5, "é,")], "id int, n double, t string")
    assert tables.write_single_csv(df, str(tmp_path / "o.csv")) == 2
    assert (tmp_path / "o.csv").read_text(encoding="utf-8").splitlines()[0] == "id,n,t"
    assert sqlite.write_sqlite(df, str(tmp_path / "o.db"), "t", key="id") == 2
    assert sorted(tuple(r) for r in sqlite.read_sqlite(spark, str(tmp_path / "o.db"), "t").collect()) == [(1, None, "x"), (2, 2.5, "é,")]
    tables.write_table(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_tasks(spark, tmp_path):
    for n, level in ((10, "easy"), (2, "hard")):
        (tmp_path / f"task_{n}").mkdir()
        (tmp_path / f"task_{n}" / "task.json").write_text(json.dumps({"task_id": f"task_{n}", "difficulty": level, "question": "?"}))
    got = inventory.tasks(spark, str(tmp_path))
    assert [r["task_id"] for r in got.collect()] == ["task_2", "task_10"]
    assert inventory.task_counts(got).count() == 2


def test_stream_equals_batch_and_survives_replay(spark, tmp_path):
    rows = [(1, 1, "a", None), (1, 2, None, 5), (2, 1, "b", 1), (1, 3, "c", None), (2, 2, "", None)]
    schema = "k int, at int, x string, y int"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = upsert.run_upserts(spark, stream, "k", "at", str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "c", 5), (2, "b", 1)]
    folded = upsert.fold(spark.createDataFrame(rows, schema), "k", "at")
    assert sorted(map(str, upsert.combine(folded, folded, "k").collect())) == sorted(map(str, folded.collect()))


def test_llm_is_optional():
    import subprocess
    import sys

    code = "import sys; sys.modules['tamarack.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p2_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0], check=False).returncode == 0


def test_json_lines_of_columns(spark):
    df = spark.range(3).select(F.col("id"))
    assert tables.infer_types(df.select(F.col("id").cast("string").alias("id"))) == {"id": "bigint"}
