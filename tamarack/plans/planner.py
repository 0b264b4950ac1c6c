"""Join paths over foreign-key edges, and plans of outputs and filters compiled to DataFrames.

Edge lists are metadata; path search runs on the driver. The compiled plan is
left to Catalyst: a chain of equi-joins, one filter, one projection or aggregate.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators.probes import predicate


@dataclass(frozen=True)
class Edge:
    source: str
    source_column: str
    target: str
    target_column: str
    weight: float = 1.0

    def turned(self) -> Edge:
        return Edge(self.target, self.target_column, self.source, self.source_column, self.weight)


@dataclass(frozen=True)
class Output:
    table: str
    column: str
    aggregate: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class Filter:
    table: str
    column: str
    op: str
    value: object = None


@dataclass
class Plan:
    outputs: list[Output]
    filters: list[Filter] = field(default_factory=list)


def adjacency(edges: list[Edge]) -> dict[str, list[Edge]]:
    out: dict[str, list[Edge]] = {}
    for e in sorted(edges, key=lambda e: (e.source, e.target, e.source_column)):
        out.setdefault(e.source, []).append(e)
        out.setdefault(e.target, []).append(e.turned())
    return out


def _cost(e: Edge) -> float:
    return max(0.0, 1 - e.weight) + 0.1 - (0.01 if e.source_column.lower().startswith(e.target.lower()) else 0.0)


def shortest_path(edges: list[Edge], start: str, goal: str, most: int = 4) -> list[Edge] | None:
    """The cheapest path of at most most edges; an edge costs what its weight lacks to 1, besides its length."""
    ways, queue, count = adjacency(edges), [(0.0, 0, start, [])], 0
    done: dict[str, float] = {}
    while queue:
        cost, _, at, path = heapq.heappop(queue)
        if at == goal:
            return path
        if done.get(at, 1e9) <= cost or len(path) == most:
            continue
        done[at] = cost
        for e in ways.get(at, []):
            count += 1
            heapq.heappush(queue, (cost + _cost(e), count, e.target, [*path, e]))
    return None


def all_paths(edges: list[Edge], start: str, goal: str, most: int = 3) -> list[list[Edge]]:
    """All paths without repeated tables, fewest edges first, then heaviest."""
    ways, found = adjacency(edges), []

    def walk(at: str, path: list[Edge], seen: frozenset[str]) -> None:
        if at == goal and path:
            found.append(path)
        elif len(path) < most:
            for e in ways.get(at, []):
                if e.target not in seen:
                    walk(e.target, [*path, e], seen | {e.target})

    walk(start, [], frozenset((start,)))
    return sorted(found, key=lambda p: (len(p), -path_score(p), [e.target for e in p]))


def path_score(path: list[Edge]) -> float:
    """Mean weight of the edges; an empty path scores 1."""
    return sum(e.weight for e in path) / len(path) if path else 1.0


def steiner_path(edges: list[Edge], required: list[str]) -> list[Edge]:
    """Edges that connect all required tables: the nearest one is attached, again and again."""
    joined, out = [required[0]], []
    left = [t for t in dict.fromkeys(required) if t != required[0]]
    while left:
        options = [(len(p), joined.index(a), b, p) for a in joined for b in left if (p := shortest_path(edges, a, b))]
        if not options:
            raise ValueError(f"no join path connects {left} with {joined}")
        _, _, b, path = min(options, key=lambda o: o[:3])
        for e in path:
            if e.target not in joined:
                out.append(e)
                joined.append(e.target)
        left = [t for t in left if t not in joined]
    return out


def compile_plan(plan: Plan, tables: dict[str, DataFrame], edges: list[Edge]) -> DataFrame:
    """The DataFrame of a plan. Columns are qualified by table; outputs with an aggregate group by those without."""
    needed = list(dict.fromkeys([o.table for o in plan.outputs] + [f.table for f in plan.filters]))
    path = steiner_path(edges, needed)
    qualified = lambda t, c: f"{t}__{c}"

    def renamed(t: str) -> DataFrame:
        return tables[t].select(*(F.col(c).alias(qualified(t, c)) for c in tables[t].columns))

    df = renamed(needed[0])
    for e in path:
        df = df.join(renamed(e.target), F.col(qualified(e.source, e.source_column)) == F.col(qualified(e.target, e.target_column)))
    for f in plan.filters:
        df = df.where(predicate(qualified(f.table, f.column), f.op, f.value))
    name = lambda o: o.name or (f"{o.aggregate}_{o.column}" if o.aggregate else o.column)
    plain = [F.col(qualified(o.table, o.column)).alias(name(o)) for o in plan.outputs if not o.aggregate]
    functions = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct}
    aggregates = [functions[o.aggregate](qualified(o.table, o.column)).alias(name(o)) for o in plan.outputs if o.aggregate]
    if not aggregates:
        return df.select(*plain).distinct()
    grouped = df.groupBy(*plain) if plain else df
    return grouped.agg(*aggregates).select(*(name(o) for o in plan.outputs))


def edges_of(foreign_keys: DataFrame) -> list[Edge]:
    return [Edge(r["source_table"], r["source_column"], r["target_table"], r["target_column"], r["overlap"]) for r in foreign_keys.collect()]


def stem_overlap(a: set[str], b: set[str]) -> set[str]:
    """Words of a that b has, or of which one begins with the other (three letters at least)."""
    return {u for u in a if u in b or any(min(len(u), len(v)) >= 3 and (u.startswith(v) or v.startswith(u)) for v in b)}


def score_column(phrase: str, name: str, description: str = "", samples: tuple[str, ...] = (), kind: str = "", distinct: int = 0, is_filter: bool = True) -> float:
    """How well a phrase names a column.

    Name: 10 where it contains the phrase, 8 where the phrase contains it, else
    6 times the share of the phrase's words it has; 3 more for two words or
    more of a longer name. Description: 1.5 a word, 5 at most. For filters also
    the first sample equal (8) or contained (5), the type that suits (numbers 3,
    text 2), and 1 each above 10 and 100 distinct values. Below 1 is 0.
    """
    p, n = phrase.lower().strip(), name.lower()
    words, own = set(re.findall(r"[a-z]{2,}", p)), set(re.findall(r"[a-z]{2,}", n))
    tight, bare = p.replace(" ", ""), re.sub(r"[ _()-]", "", n)
    hits = stem_overlap(words, own)
    score = 10.0 if p in n or tight in bare else 8.0 if n in p or bare in tight else 6.0 * len(hits) / max(1, len(words))
    if len(own) > 1 and len(words) > 1 and len(hits) >= 2:
        score += 3.0
    score += min(1.5 * len(stem_overlap(words, set(re.findall(r"[a-z]{3,}", description.lower())))), 5.0)
    if is_filter:
        low = [s for s in (str(x).lower() for x in samples) if len(s) >= 3]
        score += next((8.0 if p == s else 5.0 for s in low if p in s or s in p), 0.0)
        numeric, text = kind in ("bigint", "int", "double", "float"), kind in ("string", "")
        if re.fullmatch(r"[<>!=]*\s*\d+\.?\d*", p):
            score += 3.0 if numeric else 0.0
        else:
            score += 2.0 if text else 0.0
        score += (distinct > 10) + (distinct > 100)
    return score if score >= 1 else 0.0


@dataclass(frozen=True)
class ColumnFacts:
    """What the planner knows of a column."""

    table: str
    name: str
    kind: str = ""
    description: str = ""
    samples: tuple[str, ...] = ()
    distinct: int = 0


def map_phrase(phrase: str, columns: list[ColumnFacts], best: int = 5, is_filter: bool = True, values: frozenset[tuple[str, str]] = frozenset(), similar: dict[tuple[str, str], dict[tuple[str, str], float]] | None = None) -> list[tuple[float, str, str]]:
    """(score, table, column) of the best columns for a phrase.

    values: (table, column) pairs whose value index holds the phrase, 8 more for
    filters without an exact name. similar: columns like a column; half of its
    score times the similarity goes to each.
    """
    scores: dict[tuple[str, str], float] = {}
    for c in columns:
        s = score_column(phrase, c.name, c.description, c.samples, c.kind, c.distinct, is_filter)
        if is_filter and (c.table, c.name) in values and phrase.lower().strip() != c.name.lower():
            s += 8.0
        scores[c.table, c.name] = s
    passed: dict[tuple[str, str], float] = {}
    for at, near in (similar or {}).items():
        for other, likeness in near.items():
            if scores.get(at, 0) > 0:
                passed[other] = max(passed.get(other, 0.0), scores[at] * likeness * 0.5)
    for at, s in passed.items():
        scores[at] = max(scores.get(at, 0.0), s)
    ranked = sorted(((round(s, 4), t, c) for (t, c), s in scores.items() if s > 0), key=lambda x: (-x[0], x[1], x[2]))
    return ranked[:best]


def similarity_edges(edges: list[Edge], similar: list[tuple[str, str, str, str, float]]) -> list[Edge]:
    """Weak edges, 0.4 of the similarity, between tables that no key links: a column's name without its suffix must stand in the other table's name, or hold it."""
    linked = {frozenset((e.source, e.target)) for e in edges}
    out = []
    for t, a, u, b, likeness in similar:
        stem = lambda c: re.sub(r"_?(?:id|key|code|no|num)$", "", c.lower()).replace("_", "")
        names = lambda c, table: len(stem(c)) >= 3 and (stem(c) in table.lower() or table.lower() in stem(c))
        if t != u and frozenset((t, u)) not in linked and (names(a, u) or names(b, t)):
            out.append(Edge(t, a, u, b, likeness * 0.4))
            linked.add(frozenset((t, u)))
    return out


def alternative_paths(edges: list[Edge], required: list[str], most: int = 3) -> list[list[Edge]]:
    """The second and third best path of each pair of required tables, where there are any."""
    pairs = [(a, b) for k, a in enumerate(required) for b in required[k + 1 :]]
    return [p for a, b in pairs for p in all_paths(edges, a, b, most)[1:3]]
