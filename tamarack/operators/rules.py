"""Filter repairs. Each rule returns a proposal with its reason beside the original; nothing is replaced silently."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.operators.lookup import find_value
from tamarack.operators.probes import all_of, drop_one, predicate
from tamarack.operators.profile import approximate_fences, fences, linear_percentile, range_percentiles


@dataclass(frozen=True)
class FilterTerm:
    column: str
    op: str
    value: object = None

    def condition(self) -> Column:
        return predicate(self.column, self.op, self.value)


@dataclass(frozen=True)
class Proposal:
    rule: str
    original: tuple[FilterTerm, ...]
    repaired: tuple[FilterTerm, ...]
    reason: str


def _counts(df: DataFrame, *conditions: Column) -> list[int]:
    """How many rows meet each condition, in one pass."""
    return list(df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"k{i}") for i, c in enumerate(conditions))).first())


def parse_range(text: str, column: str) -> tuple[float, float] | None:
    """A normal range that a text states for a column: "GLU ... between 70 and 110" or "GLU: 70-110"."""
    m = re.search(rf"\b{re.escape(column)}\b[^.\n]{{0,120}}?(-?\d+(?:\.\d+)?)\s*(?:-|–|to|and)\s*(-?\d+(?:\.\d+)?)", text, re.I)
    if not m:
        return None
    low, high = float(m[1]), float(m[2])
    return (low, high) if low <= high else None


def normal_range(df: DataFrame, column: str, normal: bool, knowledge: str = "") -> Proposal | None:
    """"normal" or "abnormal" as a range: from the knowledge text, else from the distribution; abnormal keeps the sides that have rows."""
    known = parse_range(knowledge, column)
    if known is None:
        points = range_percentiles(df, column)
        if not points:
            return None
        known = fences(points)
    low, high = known
    original = (FilterTerm(column, "=", "normal" if normal else "abnormal"),)
    if normal:
        return Proposal("normal_range", original, (FilterTerm(column, ">=", low), FilterTerm(column, "<=", high)), f"normal {column} is {low} to {high}")
    below, above = _counts(df, F.col(column) < low, F.col(column) > high)
    terms = tuple(t for t, n in ((FilterTerm(column, "<", low), below), (FilterTerm(column, ">", high), above)) if n)
    return Proposal("normal_range", original, terms, f"{below} below {low}, {above} above {high}") if terms else None


def impossible_threshold(df: DataFrame, terms: list[FilterTerm]) -> list[Proposal]:
    """Two numeric predicates or more on a column that each match nothing become IS NOT NULL."""
    numeric = [t for t in terms if t.op in ("<", "<=", ">", ">=")]
    if not numeric:
        return []
    hits = dict(zip(numeric, _counts(df, *(t.condition() for t in numeric)), strict=True))
    out = []
    for column in dict.fromkeys(t.column for t in numeric):
        own = tuple(t for t in numeric if t.column == column)
        if len(own) >= 2 and all(hits[t] == 0 for t in own):
            out.append(Proposal("impossible_threshold", own, (FilterTerm(column, "IS NOT NULL"),), "each bound alone matches no row"))
    return out


def coverage_simplification(df: DataFrame, terms: list[FilterTerm]) -> list[Proposal]:
    """A predicate that all non-null rows meet says IS NOT NULL."""
    tested = [t for t in terms if t.op != "IS NOT NULL"]
    if not tested:
        return []
    counts = _counts(df, *(c for t in tested for c in (t.condition(), F.col(t.column).isNotNull())))
    return [Proposal("coverage", (t,), (FilterTerm(t.column, "IS NOT NULL"),), f"matches all {counts[2 * i]} values") for i, t in enumerate(tested) if counts[2 * i] and counts[2 * i] == counts[2 * i + 1]]


def plausibility(df: DataFrame, entity: str, terms: list[FilterTerm]) -> Proposal | None:
    """All filters together match nothing: leave out the one whose removal gives most entities."""
    names = [str(i) for i in range(len(terms))]
    conditions = [t.condition() for t in terms]
    counts = df.agg(F.count_if(all_of(conditions)).alias("all"), *(F.count_distinct(F.when(all_of([c for j, c in enumerate(conditions) if j != i]), F.col(entity))).alias(n) for i, n in enumerate(names))).first()
    if counts["all"] or len(terms) < 2:
        return None
    best = max(range(len(terms)), key=lambda i: (counts[str(i)], -i))
    if not counts[str(best)]:
        return None
    return Proposal("plausibility", tuple(terms), tuple(t for i, t in enumerate(terms) if i != best), f"without {terms[best].column} {counts[str(best)]} entities remain")


def temporal_format(df: DataFrame, term: FilterTerm) -> Proposal | None:
    """= day against longer stored text becomes a prefix match."""
    if term.op != "=" or not re.fullmatch(r"\d{4}-\d{2}(?:-\d{2})?", str(term.value)):
        return None
    exact, prefix = _counts(df, term.condition(), F.col(term.column).cast("string").startswith(str(term.value)))
    return Proposal("temporal_format", (term,), (FilterTerm(term.column, "LIKE", f"{term.value}%"),), f"{prefix} rows begin with the day") if not exact and prefix else None


def existence(df: DataFrame, term: FilterTerm, sparse: float = 0.7, share: float = 0.1) -> Proposal | None:
    """On a sparse column a filter that keeps less than a tenth of the values may mean that there is one."""
    total, there, hit = _counts(df, F.lit(True), F.col(term.column).isNotNull(), term.condition())
    if total and 1 - there / total > sparse and hit < share * there:
        return Proposal("existence", (term,), (FilterTerm(term.column, "IS NOT NULL"),), f"{hit} of {there} values, {total} rows")
    return None


def cross_row(df: DataFrame, entity: str, terms: list[FilterTerm], least: float = 1.5) -> Proposal | None:
    """Conditions that hold on different rows of an entity: only where entities have several rows and it makes a difference."""
    conditions = [t.condition() for t in terms]
    per = df.groupBy(entity).agg(F.count("*").alias("n"), F.max(F.coalesce(all_of(conditions), F.lit(False))).alias("same"), *(F.max(F.coalesce(c, F.lit(False))).alias(f"k{i}") for i, c in enumerate(conditions)))
    row = per.agg(F.avg("n").alias("rows"), F.count_if("same").alias("same"), F.count_if(all_of([F.col(f"k{i}") for i in range(len(terms))])).alias("across")).first()
    if (row["rows"] or 0) > least and row["same"] != row["across"]:
        return Proposal("cross_row", tuple(terms), tuple(terms), f"{row['same']} entities in one row, {row['across']} across rows")
    return None


def ratio(df: DataFrame, entity: str, terms: list[FilterTerm], kind: str) -> DataFrame:
    """value of a ratio over all rows, not over those a filter keeps.

    kind: percentage (rows that meet the terms, of all), entities (distinct
    entities that meet them, of all), increase (rows of the last term over those
    of the first).
    """
    whole = all_of([t.condition() for t in terms])
    if kind == "percentage":
        value = 100.0 * F.count_if(whole) / F.count("*")
    elif kind == "entities":
        value = 100.0 * F.count_distinct(F.when(whole, F.col(entity))) / F.count_distinct(entity)
    elif kind == "increase":
        value = F.count_if(terms[-1].condition()) / F.nullif(F.count_if(terms[0].condition()), F.lit(0))
    else:
        raise ValueError(f"unknown ratio {kind}")
    return df.agg(F.round(value, 6).alias("value"))


def ratio_pattern(terms: list[FilterTerm], kind: str) -> Proposal | None:
    """For a ratio the terms belong into the numerator: as filters they would also cut the denominator."""
    if kind not in ("percentage", "entities", "increase") or not terms:
        return None
    return Proposal("ratio", tuple(terms), (), f"{len(terms)} filters go into the numerator of the {kind}")


def count_distinct_rule(plan_tables: list[str], entity_table: str, key: str, counts: bool = True) -> Proposal | None:
    """A count over joined tables counts the entity's key distinctly: a join repeats rows."""
    if not counts or len({*plan_tables, entity_table}) < 2:
        return None
    return Proposal("count_distinct", (), (FilterTerm(f"{entity_table}.{key}", "COUNT DISTINCT"),), "the join repeats rows of the entity")


@dataclass(frozen=True)
class Plausibility:
    plausible: bool
    rows: int
    anomaly: str = ""


def assess_plausibility(df: DataFrame, entity: str, terms: list[FilterTerm], asks: str = "count", single: bool = False) -> Plausibility:
    """Whether what a filter keeps can be an answer, in one pass.

    Not plausible: nothing at all; more than five entities where one value is
    asked for; for counts more than four fifths of all entities in spite of two
    terms or more that restrict. Ratios are always plausible, 0 among them.
    """
    if asks in ("ratio", "percentage"):
        return Plausibility(True, -1)
    whole = all_of([t.condition() for t in terms])
    row = df.agg(F.count_distinct(F.when(whole, F.col(entity))).alias("n"), F.count_distinct(entity).alias("all")).first()
    n, every = row["n"], row["all"]
    if not n:
        return Plausibility(False, 0, "nothing is kept")
    if single and asks == "lookup" and n > 5:
        return Plausibility(False, n, f"one value is asked for, {n} are kept")
    if asks == "count" and every and n > 0.8 * every and sum(t.op != "IS NOT NULL" for t in terms) >= 2:
        return Plausibility(False, n, f"{n} of {every} in spite of {len(terms)} filters")
    return Plausibility(True, n)


RULES = ("normal_range", "impossible_threshold", "coverage", "plausibility", "temporal_format", "cross_row", "ratio", "existence")


def repair(df: DataFrame, entity: str, terms: list[FilterTerm], knowledge: str = "", asks: str = "") -> list[Proposal]:
    """All proposals for a filter, in the order of RULES; knowledge: text that may state normal ranges, asks: the kind of ratio wanted, if one is."""
    out = [p for t in terms if str(t.value).lower() in ("normal", "abnormal") and (p := normal_range(df, t.column, str(t.value).lower() == "normal", knowledge))]
    named = {p.original[0].column for p in out}
    plain = [t for t in terms if t.column not in named]
    out += impossible_threshold(df, plain) + coverage_simplification(df, plain)
    one = plausibility(df, entity, plain) if plain else None
    out += [one] if one else []
    out += [p for t in plain if (p := temporal_format(df, t))]
    across = cross_row(df, entity, plain) if len(plain) > 1 else None
    out += [across] if across else []
    part = ratio_pattern(plain, asks) if asks else None
    out += [part] if part else []
    return out + [p for t in plain if t.op != "IS NOT NULL" and (p := existence(df, t))]


def relocate(tables: dict[str, DataFrame], table: str, term: FilterTerm) -> list[tuple[str, str, int]]:
    """(table, column, rows) of other columns that hold the value of an equality that keeps nothing, most rows first."""
    if term.op != "=" or not isinstance(term.value, str) or _counts(tables[table], term.condition())[0]:
        return []
    rows = find_value(tables, term.value).where("exact > 0").collect()
    return sorted(((r["table_name"], r["column_name"], r["exact"]) for r in rows if (r["table_name"], r["column_name"]) != (table, term.column)), key=lambda x: (-x[2], x[0], x[1]))


def out_of_range(df: DataFrame, terms: list[FilterTerm]) -> list[str]:
    """Thresholds beyond all values of their column, as notes; one pass."""
    numeric = [t for t in terms if t.op in ("<", "<=", ">", ">=") and isinstance(t.value, int | float)]
    if not numeric:
        return []
    row = df.agg(*(x for i, t in enumerate(numeric) for x in (F.min(t.column).alias(f"a{i}"), F.max(t.column).alias(f"b{i}")))).first()
    return [f"{t.column} {t.op} {t.value} lies outside {row[f'a{i}']} to {row[f'b{i}']}" for i, t in enumerate(numeric) if row[f"a{i}"] is not None and not row[f"a{i}"] <= t.value <= row[f"b{i}"]]


def adapt(tables: dict[str, DataFrame], table: str, entity: str, terms: list[FilterTerm], asks: str = "count", rounds: int = 3) -> tuple[list[FilterTerm], list[str]]:
    """(terms, log) after repairs, again and again until the result is plausible, nothing changes, or rounds are over.

    A term that keeps nothing but whose value another column of the table has
    moves there; else the best scored hypothesis is taken.
    """
    log: list[str] = []
    for _ in range(rounds):
        report = assess_plausibility(tables[table], entity, terms, asks)
        if report.plausible:
            break
        log += [report.anomaly, *out_of_range(tables[table], terms)]
        moved = [next((FilterTerm(c, "=", t.value) for u, c, _ in relocate(tables, table, t) if u == table), t) for t in terms]
        if moved == terms:
            better = best_hypothesis(tables[table], entity, terms, asks)
            moved = list(better.terms) if better else terms
        if moved == terms:
            break
        log.append(" and ".join(f"{t.column} {t.op} {t.value}" for t in moved))
        terms = moved
    return terms, log


@dataclass(frozen=True)
class Hypothesis:
    """A reading of a filter: its terms (alternatives joined by OR where any is set), or a hint about grain."""

    label: str
    terms: tuple[FilterTerm, ...]
    any_of: bool = False
    hint: str = ""

    def condition(self) -> Column:
        conditions = [t.condition() for t in self.terms]
        return reduce(lambda a, b: a | b, conditions) if self.any_of else all_of(conditions)


@dataclass(frozen=True)
class Evidence:
    """What is known of a filter: per term rows kept and the column's facts, entities with each term dropped, rows per entity."""

    kept: dict[str, int]
    facts: dict[str, dict[str, float]]
    dropped: dict[str, int]
    rows_per_entity: float


def gather_evidence(df: DataFrame, entity: str, terms: list[FilterTerm]) -> Evidence:
    """Evidence in two passes: one aggregate over rows, one over entities."""
    columns = list(dict.fromkeys(t.column for t in terms))
    number = lambda c: F.col(c).cast("string").try_cast("double")
    aggregates = [F.count_if(F.coalesce(t.condition(), F.lit(False))).alias(f"k{i}") for i, t in enumerate(terms)]
    for i, c in enumerate(columns):
        aggregates += [F.min(number(c)).alias(f"lo{i}"), F.max(number(c)).alias(f"hi{i}"), F.avg(number(c)).alias(f"mean{i}"), F.count(c).alias(f"n{i}"), F.count_if(number(c) == 0).alias(f"zero{i}")]
    row = df.agg(F.count("*").alias("rows"), F.count_distinct(entity).alias("entities"), *aggregates).first()
    facts = {c: {"min": row[f"lo{i}"], "max": row[f"hi{i}"], "mean": row[f"mean{i}"], "filled": row[f"n{i}"], "zeros": row[f"zero{i}"], "null_ratio": 1 - row[f"n{i}"] / row["rows"] if row["rows"] else 0.0} for i, c in enumerate(columns)}
    names = {f"{i}": t.condition() for i, t in enumerate(terms)}
    dropped = {r["dropped"]: r["entities"] for r in drop_one(df, entity, names).collect()}
    return Evidence({f"{i}": row[f"k{i}"] for i in range(len(terms))}, facts, dropped, row["rows"] / row["entities"] if row["entities"] else 0.0)


_INVERTED = {"<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def hypotheses(df: DataFrame, entity: str, terms: list[FilterTerm], question: str = "", evidence: Evidence | None = None, foreign: list[tuple[FilterTerm, FilterTerm]] = ()) -> list[Hypothesis]:
    """Readings of a filter that the data and the words of the question allow.

    foreign: (term, the same term on another column) pairs, for values that
    live elsewhere.
    """
    q, e = question.lower(), evidence or gather_evidence(df, entity, terms)
    says = lambda *words: any(w in q for w in words)
    swap = lambda i, *new: tuple(x for j, t in enumerate(terms) for x in (new if j == i else (t,)))
    out = [Hypothesis("as_is", tuple(terms))]
    if len(terms) > 1:
        out += [Hypothesis(f"without_{t.column}", tuple(x for j, x in enumerate(terms) if j != i)) for i, t in enumerate(terms)]
        out.append(Hypothesis("any_of", tuple(terms), any_of=True))
    for column in dict.fromkeys(t.column for t in terms):
        own = [t for t in terms if t.column == column and t.op in ("<", "<=", ">", ">=")]
        if len(own) > 1:
            tight = {s: (min if s == "<" else max)((t for t in own if t.op[0] == s), key=lambda t: t.value, default=None) for s in "<>"}
            rest = tuple(t for t in terms if t not in own)
            out.append(Hypothesis(f"one_bound_{column}", rest + tuple(t for t in tight.values() if t)))
    for i, t in enumerate(terms):
        f = e.facts[t.column]
        number = isinstance(t.value, int | float) and not isinstance(t.value, bool)
        if t.op in _INVERTED and number:
            step = abs(t.value) * 0.05
            out.append(Hypothesis(f"wider_{t.column}", swap(i, FilterTerm(t.column, t.op, t.value + (step if t.op[0] == "<" else -step)))))
            out.append(Hypothesis(f"inverted_{t.column}", swap(i, FilterTerm(t.column, _INVERTED[t.op], t.value))))
            if f["mean"] is not None and says("average", "mean", "above", "below"):
                out.append(Hypothesis(f"mean_{t.column}", swap(i, FilterTerm(t.column, "<" if says("below") else ">", round(f["mean"], 4)))))
            if f["min"] is not None and says("abnormal", "outlier", "unusual"):
                low, high = approximate_fences(f["min"], f["max"], f["mean"])
                out.append(Hypothesis(f"outlier_{t.column}", (FilterTerm(t.column, "<", round(low, 2)), FilterTerm(t.column, ">", round(high, 2))), any_of=True))
            if f["min"] is not None and (m := re.search(r"(top|bottom|above|below)\s*(\d+)\s*%", q)):
                top = m[1] in ("top", "above")
                out.append(Hypothesis(f"percent_{t.column}", swap(i, FilterTerm(t.column, ">=" if top else "<=", linear_percentile(f["min"], f["max"], float(m[2]), top)))))
            if e.rows_per_entity > 1.5 and says("total", "average", "overall", "combined", "cumulative"):
                out.append(Hypothesis(f"per_entity_{t.column}", tuple(terms), hint=f"{t.column} {t.op} {t.value} may hold for each entity's aggregate"))
        if t.op == "=":
            if isinstance(t.value, str):
                out += [Hypothesis(f"like_{t.column}", swap(i, FilterTerm(t.column, "LIKE", f"%{t.value}%")))]
                if re.fullmatch(r"\d{4}(?:-\d{2}){0,2}", t.value):
                    out.append(Hypothesis(f"period_{t.column}", swap(i, FilterTerm(t.column, "LIKE", f"{t.value}%"))))
            elif number and t.value in (0, 1):
                out.append(Hypothesis(f"flag_{t.column}", swap(i, FilterTerm(t.column, "=", 1 - t.value))))
        if f["null_ratio"] > 0.7:
            out.append(Hypothesis(f"there_{t.column}", swap(i, FilterTerm(t.column, "IS NOT NULL"))))
        if f["zeros"]:
            out.append(Hypothesis(f"not_zero_{t.column}", swap(i, FilterTerm(t.column, "<>", 0))))
    out += [Hypothesis(f"moved_{a.column}", tuple(b if t == a else t for t in terms)) for a, b in foreign]
    if e.rows_per_entity > 1.5:
        out.append(Hypothesis("across_rows", tuple(terms), hint="the terms may hold on different rows of an entity"))
    if says("latest", "most recent", "newest", "current"):
        out.append(Hypothesis("latest", tuple(terms), hint="the latest row of each entity"))
    if says("different", "unique", "distinct"):
        out.append(Hypothesis("distinct", tuple(terms), hint="distinct values"))
    return list({h.label: h for h in out}.values())


def scored(df: DataFrame, entity: str, found: list[Hypothesis], asks: str = "count", single: bool = False, ranges: dict[str, tuple[float, float]] | None = None) -> list[tuple[float, int, Hypothesis]]:
    """(score, entities kept, hypothesis), best first; all are counted in one pass.

    Nothing kept is -100; else 10, 5 more for counts up to 50, 20 less for more
    than 5 where one value is looked up, 3 more for each bound of a known range,
    1 less for each IS NOT NULL.
    """
    row = df.agg(*(F.count_distinct(F.when(h.condition(), F.col(entity))).alias(f"h{i}") for i, h in enumerate(found))).first()
    out = []
    for i, h in enumerate(found):
        n = row[f"h{i}"]
        score = -100.0
        if n:
            bounds = sum(t.value in (ranges or {}).get(t.column, ()) for t in h.terms)
            score = 10.0 + (5 if asks == "count" and n <= 50 else 0) - (20 if single and asks == "lookup" and n > 5 else 0) + 3 * bounds - sum(t.op == "IS NOT NULL" for t in h.terms)
        out.append((score, n, h))
    return sorted(out, key=lambda x: -x[0])


def best_hypothesis(df: DataFrame, entity: str, terms: list[FilterTerm], asks: str = "count", question: str = "") -> Hypothesis | None:
    """The best reading that keeps anything, the first of equals."""
    ranked = scored(df, entity, hypotheses(df, entity, terms, question), asks)
    return ranked[0][2] if ranked and ranked[0][0] > 0 else None


def variants(term: FilterTerm, low: float | None = None, high: float | None = None) -> list[FilterTerm]:
    """Hypotheses about one term that need no data: bounds widened by a twentieth or inverted, equality as a prefix or a list, existence, non-zero."""
    out = []
    if term.op in _INVERTED and isinstance(term.value, int | float):
        step = abs(term.value) * 0.05
        out += [FilterTerm(term.column, term.op, term.value + (step if term.op[0] == "<" else -step)), FilterTerm(term.column, _INVERTED[term.op], term.value)]
    if term.op == "=":
        out += [FilterTerm(term.column, "LIKE", f"{term.value}%"), FilterTerm(term.column, "IN", [term.value])]
        if isinstance(term.value, int | float):
            out.append(FilterTerm(term.column, "<>", 0))
    if low is not None and high is not None:
        out.append(FilterTerm(term.column, "BETWEEN", (low, high)))
    return [*out, FilterTerm(term.column, "IS NOT NULL")]
