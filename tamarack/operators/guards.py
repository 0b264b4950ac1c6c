"""Checks of a query and its result, run in order; the first objection is returned with its name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.lookup import mentioned_values
from tamarack.operators.probes import all_of
from tamarack.operators.profile import null_like_ratios
from tamarack.operators.scoring import duplicate_rows
from tamarack.plans.inspect import conjuncts, has_cross_join, join_columns, output_origins

MOST_ROWS = 500


@dataclass(frozen=True)
class Objection:
    guard: str
    message: str
    fatal: bool = True


def repeated_rows(result: DataFrame) -> Objection | None:
    row = duplicate_rows(result).first()
    return Objection("duplicates", f"{row['duplicates']} of {row['rows']} rows repeat another") if row["duplicates"] else None


def too_many_rows(result: DataFrame, most: int = MOST_ROWS) -> Objection | None:
    """Reads one row more than allowed, not the result."""
    return Objection("row_cap", f"more than {most} rows") if result.limit(most + 1).count() > most else None


def cross_join(result: DataFrame) -> Objection | None:
    return Objection("cross_join", "tables are joined without a condition") if has_cross_join(result) else None


def mostly_empty(result: DataFrame) -> Objection | None:
    bad = [r["column_name"] for r in null_like_ratios(result).where("warned").collect()]
    return Objection("null_ratio", f"mostly empty: {', '.join(bad)}", fatal=False) if bad else None


def unverified_filter(result: DataFrame, tested: list[DataFrame]) -> Objection | None:
    """Conditions of the answer that no earlier query tested."""
    seen = {c for df in tested for c in conjuncts(df)}
    new = [c for c in conjuncts(result) if c not in seen]
    return Objection("unverified_filter", f"never tested: {'; '.join(new)}") if new else None


def vacuous_filter(df: DataFrame, conditions: dict[str, Column]) -> Objection | None:
    """Conditions that keep every row the others keep."""
    if not conditions:
        return None
    whole = all_of(list(conditions.values()))
    row = df.agg(F.count_if(whole).alias("all"), *(F.count_if(all_of([c for m, c in conditions.items() if m != n])).alias(n) for n in conditions)).first()
    idle = [n for n in conditions if row[n] == row["all"] > 1]
    return Objection("vacuous_filter", f"keeps every row: {', '.join(idle)}") if idle else None


def empty_first(df: DataFrame, column: str, ascending: bool = True) -> Objection | None:
    """An ascending order with a limit whose first row is a null or blank key."""
    order = F.asc_nulls_first(column) if ascending else F.desc_nulls_last(column)
    first = df.select(column).orderBy(order).limit(1).collect()
    return Objection("empty_order", f"the first {column} is empty") if first and (first[0][0] is None or str(first[0][0]).strip() == "") else None


def wrong_column(result: DataFrame, resolved: dict[str, str]) -> Objection | None:
    """An output column that was resolved to one table but comes from another; join keys are exempt, as both sides hold the same value.

    resolved: column -> table, the name under which the tables are registered.
    """
    bad = [f"{c} is of {t}, not of {resolved[c]}" for c, t in output_origins(result).items() if c in resolved and t and t != resolved[c] and c not in join_columns(result)]
    return Objection("column_resolution", "; ".join(bad)) if bad else None


def nameable_ids(result: DataFrame, docs: DataFrame, references: set[str] = frozenset(), least: int = 6) -> Objection | None:
    """Output columns of ids that documents can name: columns that refer to no table (references, or named link_to_) and whose values stand in a document.

    Values are looked for whole, however many there are; numbers and texts with blanks are no ids.
    """
    for c in result.columns:
        if c.lower() in references or c.lower().startswith("link_to_"):
            v = F.trim(F.col(c).cast("string"))
            ids = result.select(v.alias("value")).where((F.length("value") >= least) & ~F.rlike("value", F.lit(r"^[-0-9.]+$")) & ~F.contains("value", F.lit(" ")))
            if not mentioned_values(ids, "value", docs).isEmpty():
                return Objection("fk_resolution", f"{c} holds ids that documents name")
    return None


def unresolved_text(sql: str, spark) -> Objection | None:
    """A statement that names columns no table has; nothing runs."""
    try:
        spark.sql(sql)
    except AnalysisException as e:
        return Objection("unresolved_column", str(e.getCondition()))
    return None


@dataclass(frozen=True)
class Context:
    """What the guards know besides the result: earlier queries, the source and its named conditions, an order, resolved columns, documents."""

    tested: tuple[DataFrame, ...] = ()
    source: DataFrame | None = None
    conditions: tuple[tuple[str, Column], ...] = ()
    ordered_by: str | None = None
    ascending: bool = True
    resolved: tuple[tuple[str, str], ...] = ()
    docs: DataFrame | None = None


#: The whole chain in its order; a guard without what it needs has no objection. A cross join is looked for first: that runs nothing, and what follows would run it.
CHAIN: tuple[Callable[[DataFrame, Context], Objection | None], ...] = (
    lambda r, c: cross_join(r),
    lambda r, c: repeated_rows(r),
    lambda r, c: too_many_rows(r),
    lambda r, c: wrong_column(r, dict(c.resolved)) if c.resolved else None,
    lambda r, c: unverified_filter(r, list(c.tested)) if c.tested else None,
    lambda r, c: vacuous_filter(c.source, dict(c.conditions)) if c.source is not None and c.conditions else None,
    lambda r, c: empty_first(c.source, c.ordered_by, c.ascending) if c.source is not None and c.ordered_by else None,
    lambda r, c: mostly_empty(r),
    lambda r, c: nameable_ids(r, c.docs) if c.docs is not None else None,
)


def check(result: DataFrame, context: Context | None = None) -> list[Objection]:
    """Objections in order; what follows a fatal one is not run."""
    out = []
    for guard in CHAIN:
        found = guard(result, context or Context())
        if found:
            out.append(found)
            if found.fatal:
                break
    return out
