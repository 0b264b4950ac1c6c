"""SQLite files as a Spark data source, read in ranges of row ids, and as a sink."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tamarack.sources.tables import refuse_large

#: Rows of one range, about, and the fewest ranges of a table.
RANGE_ROWS, RANGES = 250_000, 8


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def sqlite_tables(path: str) -> list[str]:
    with closing(_connect(path)) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def sqlite_schema(path: str) -> list[tuple[str, str]]:
    """(table, DDL), by name."""
    with closing(_connect(path)) as c:
        return list(c.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name"))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kind(declared: str) -> str:
    d = (declared or "").upper()
    return "bigint" if "INT" in d or "BOOL" in d else "double" if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "string"


class RowRange(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, kinds: list[str]):
        self.path, self.table, self.kinds = path, table, kinds

    def partitions(self) -> list[RowRange]:
        with closing(_connect(self.path)) as c:
            try:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids
                return [RowRange(None, None)]
        if low is None:
            return [RowRange(0, 0)]
        step = max(1, min(RANGE_ROWS, -(-(high - low + 1) // RANGES)))
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        where, args = ("", ()) if partition.low is None else (" WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))
        with closing(_connect(self.path)) as c:
            for row in c.execute(f"SELECT * FROM {_quoted(self.table)}{where}", args):
                yield tuple(self._cell(v, k) for v, k in zip(row, self.kinds, strict=True))

    @staticmethod
    def _cell(v: object, kind: str) -> object:
        """A cell in its column's type: SQLite keeps text in number columns; what does not parse is null."""
        if v is None:
            return None
        try:
            return int(v) if kind == "bigint" else float(v) if kind == "double" else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
        except (TypeError, ValueError):
            return None


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def _columns(self) -> list[tuple[str, str]]:
        with closing(_connect(self.options["path"])) as c:
            return [(r[1], _kind(r[2])) for r in c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})")]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in self._columns())

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], [k for _, k in self._columns()])


def read_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_file").option("path", path).option("table", table).load()


def write_sqlite(df: DataFrame, path: str, table: str, key: str | None = None, protected: frozenset[str] = frozenset()) -> int:
    """A small result as a SQLite table, replaced whole; rows of one key replace each other. Returns their number.

    A protected table is left alone: the rows go to the table of its name with
    "_doc". Rows stream through the driver; larger results are refused.
    """
    refuse_large(df)
    if table.lower() in {p.lower() for p in protected}:
        table = f"{table}_doc"
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL"}
    columns = ", ".join(f"{_quoted(f.name)} {kinds.get(f.dataType.simpleString(), 'TEXT')}{' PRIMARY KEY' if f.name == key else ''}" for f in df.schema)
    plain = lambda v: v if v is None or isinstance(v, int | float | str) else str(v)
    n = 0
    with closing(sqlite3.connect(path)) as c, c:
        c.execute(f"DROP TABLE IF EXISTS {_quoted(table)}")
        c.execute(f"CREATE TABLE {_quoted(table)} ({columns})")
        for row in df.toLocalIterator():
            c.execute(f"INSERT OR REPLACE INTO {_quoted(table)} VALUES ({', '.join('?' * len(df.columns))})", tuple(plain(v) for v in row))
            n += 1
    return n
