"""Reading Spark's own plans. The private JVM handle stays in this module."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def analyzed(df: DataFrame) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def optimized(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def partitions(df: DataFrame) -> int:
    """Partitions of a scan; nothing runs."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a scan's size, from its files; nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def has_cross_join(df: DataFrame) -> bool:
    """A join without condition in the optimized plan; comma joins that a filter links are none."""
    return bool(re.search(r"^[\s:+-]*Join (?:Cross|Inner)\s*(?:, (?:left|right)Hint=.*)?$", optimized(df), re.M))


def _closes(text: str) -> int:
    """Where the bracket that a text begins with closes."""
    depth = 0
    for k, ch in enumerate(text):
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if depth == 0:
            return k
    return -1


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names below a folder of any file system Spark knows; none where it is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def split_and(text: str) -> list[str]:
    """The conjuncts of a printed condition, brackets around them taken off, however deep the ANDs are nested."""
    text = text.strip()
    while text.startswith("(") and _closes(text) == len(text) - 1:
        text = text[1:-1].strip()
    depth = 0
    for k, ch in enumerate(text):
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if depth == 0 and text.startswith(" AND ", k):
            return split_and(text[:k]) + split_and(text[k + 5 :])
    return [text]


def conjuncts(df: DataFrame) -> list[str]:
    """The conditions of the outermost filter, split at AND, attribute ids taken off."""
    m = re.search(r"^[\s:+-]*Filter (.*)$", analyzed(df), re.M)
    return split_and(re.sub(r"#\d+L?", "", m[1])) if m else []


def order_and_limit(df: DataFrame) -> tuple[str, int | None]:
    """(sort keys, limit) of the outermost order and limit of a plan; ("", None) where there are none."""
    plan = analyzed(df)
    order = re.search(r"^[\s:+-]*Sort \[(.*)\], (?:true|false)", plan, re.M)
    limit = re.search(r"^[\s:+-]*GlobalLimit (\d+)", plan, re.M)
    return re.sub(r"#\d+L?", "", order[1]) if order else "", int(limit[1]) if limit else None


def quoted_sql(line: str) -> str | None:
    """The SELECT statement in a line of Markdown: between backticks, or after its bullet or heading marks."""
    ticked = re.search(r"`\s*(select\s[^`]*)`", line, re.I)
    bare = re.match(r"[\s*#-]*(select\s.*)", line, re.I)
    found = ticked or bare
    return found[1].strip() if found else None


def where_of(line: str) -> str | None:
    """The conditions of the statement in a line of Markdown."""
    m = re.search(r"\swhere\s+(.*?)(?:\s(?:order by|limit|group by)\s.*)?$", quoted_sql(line) or "", re.I | re.S)
    return m[1].strip() or None if m else None


def order_limit_of(line: str) -> str | None:
    """The ORDER BY of the statement in a line of Markdown, and what follows it."""
    m = re.search(r"\s(order by\s.*)$", quoted_sql(line) or "", re.I | re.S)
    return m[1].strip() if m else None


def output_origins(df: DataFrame) -> dict[str, str]:
    """Output column -> the table or view it comes from, "" for computed ones; by attribute ids, so aliases in the statement do not matter."""
    plan = analyzed(df)
    ids: dict[str, str] = {}
    alias: list[tuple[int, str]] = []
    for line in plan.splitlines():
        m = re.match(r"([\s:+-]*)(.*)", line)
        depth, node = len(m[1]), m[2]
        alias = [a for a in alias if a[0] < depth]
        if n := re.match(r"SubqueryAlias (\S+)", node):
            alias.append((depth, n[1].split(".")[-1].strip("`")))
        elif alias:
            for k in re.findall(r"\w+#(\d+)", node):
                ids.setdefault(k, alias[-1][1])
    first = next((x for x in plan.splitlines() if re.match(r"[\s:+-]*(?:Project|Aggregate)\b", x)), plan.splitlines()[0])
    names = re.search(r"\[([^\[]*)\]\s*$", first)
    out = {}
    for part in re.split(r",\s*(?![^(]*\))", names[1]) if names else []:
        m = re.search(r"(\w+)#(\d+)L?$", part.strip())
        if m:
            source = re.match(r"(\w+)#(\d+)L? AS ", part.strip())
            out[m[1]] = ids.get(source[2] if source else m[2], "")
    return out


def join_columns(df: DataFrame) -> set[str]:
    """Columns that the plan's joins compare."""
    return {n for m in re.finditer(r"Join \w+, (.*)", analyzed(df)) for n in re.findall(r"(\w+)#\d+", m[1])}


def is_query(spark: SparkSession, sql: str) -> bool:
    """Whether a statement only reads."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    name = plan.getClass().getSimpleName()
    return not re.search(r"Command|Create|Drop|Insert|Update|Delete|Merge|Alter|Truncate|Set|Cache|Refresh|Load|Replace", name)


def read_sql(spark: SparkSession, sql: str) -> DataFrame:
    """A read-only statement as a DataFrame; commands are refused, unknown columns raise before anything runs."""
    if not is_query(spark, sql):
        raise ValueError("only queries are allowed")
    return spark.sql(sql)


def scanned_columns(df: DataFrame) -> set[str]:
    """Columns the scans of the physical plan read."""
    text = executed(df)
    return {c.split(":")[0] for m in re.finditer(r"ReadSchema: struct<([^>]*)>", text) for c in m[1].split(",") if c}


def same_query(a: DataFrame, b: DataFrame) -> bool:
    return a.sameSemantics(b)
