"""Facts and approaches remembered between questions, as tables."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights of the parts of an approach.
WEIGHTS = {"tables": 2.0, "filters": 1.5, "aggregates": 1.0, "joins": 1.5, "selects": 1.0, "grain": 0.5, "temporal": 0.5}


def fingerprint(tables: dict[str, list[str]]) -> str:
    """Sixteen hex digits that stand for table and column names, in any order."""
    text = ";".join(f"{t}({','.join(sorted(cs))})" for t, cs in sorted(tables.items()))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def upsert_facts(facts: DataFrame) -> DataFrame:
    """node, subject, fact, confidence, superseded: repeated facts gain confidence, an earlier fact on the same subject is superseded.

    facts: node, subject, fact, at. Ties in time go to the greater fact.
    """
    counted = facts.groupBy("node", "subject", "fact").agg(F.count("*").alias("confidence"), F.max("at").alias("at"))
    newest = facts.groupBy("node", "subject").agg(F.max(F.struct("at", "fact")).alias("newest"))
    return counted.join(newest, ["node", "subject"]).select("node", "subject", "fact", "confidence", (F.struct("at", "fact") < F.col("newest")).alias("superseded"))


@dataclass(frozen=True)
class Approach:
    """What a query does, as sets of names."""

    tables: frozenset[str] = field(default_factory=frozenset)
    filters: frozenset[str] = field(default_factory=frozenset)
    aggregates: frozenset[str] = field(default_factory=frozenset)
    joins: frozenset[str] = field(default_factory=frozenset)
    selects: frozenset[str] = field(default_factory=frozenset)
    grain: frozenset[str] = field(default_factory=frozenset)
    temporal: frozenset[str] = field(default_factory=frozenset)


def approach_of(sql: str) -> Approach:
    """The parts of a statement by its words; enough to tell approaches apart, not a parser."""
    text = re.sub(r"\s+", " ", sql.strip().rstrip(";").lower())
    found = lambda p: frozenset(re.findall(p, text))
    where = re.search(r"\bwhere (.*?)(?:\bgroup by\b|\border by\b|\blimit\b|$)", text)
    select = re.search(r"\bselect (?:distinct )?(.*?)\bfrom\b", text)
    group = re.search(r"\bgroup by (.*?)(?:\bhaving\b|\border by\b|\blimit\b|$)", text)
    parts = lambda m, sep: frozenset(x.strip() for x in re.split(sep, m[1]) if x.strip()) if m else frozenset()
    return Approach(found(r"\b(?:from|join) (\w+)"), parts(where, r"\band\b|\bor\b"), found(r"\b(count|sum|avg|min|max)\s*\("), found(r"\bon ([\w.]+ = [\w.]+)"), parts(select, r",(?![^(]*\))"), parts(group, ","), found(r"\b(date|year|month|strftime|date_format)\b"))


def similarity(a: Approach, b: Approach) -> float:
    """Weighted overlap of the parts that either approach has, 0 to 1."""
    total = score = 0.0
    for name, w in WEIGHTS.items():
        x, y = getattr(a, name), getattr(b, name)
        if x or y:
            total += w
            score += w * len(x & y) / len(x | y)
    return round(score / total, 6) if total else 0.0


def similar(approaches: dict[str, Approach], wanted: Approach, least: float = 0.5) -> list[tuple[float, str]]:
    """(similarity, name) above least, best first."""
    return sorted(((s, n) for n, a in approaches.items() if (s := similarity(a, wanted)) > least), key=lambda x: (-x[0], x[1]))


def save_facts(facts: DataFrame, folder: str, fingerprint_: str) -> None:
    """Writes the facts of one schema to its partition of a folder on any file system; the others stay."""
    facts.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/fingerprint={fingerprint_}")


def load_facts(spark: SparkSession, folder: str, fingerprint_: str) -> DataFrame | None:
    """The facts of a schema, or None where none were saved."""
    try:
        return spark.read.parquet(f"{folder.rstrip('/')}/fingerprint={fingerprint_}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
