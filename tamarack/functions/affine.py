"""Unit conversion as a graph of affine functions.

Vertices are units, an edge (a, b) maps x in its source unit to a * x + b in
its target unit. Compositions along shortest paths are computed once, and every
cycle must come back to the identity.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass


@dataclass(frozen=True)
class Affine:
    a: float
    b: float = 0.0

    def then(self, other: Affine) -> Affine:
        return Affine(other.a * self.a, other.a * self.b + other.b)

    def inverse(self) -> Affine:
        return Affine(1 / self.a, -self.b / self.a)

    def __call__(self, x: float) -> float:
        return self.a * x + self.b


class UnitGraph:
    """Units of one quantity; conversions are found along the fewest edges."""

    def __init__(self, edges: dict[tuple[str, str], Affine]):
        self.next: dict[str, dict[str, Affine]] = {}
        for (source, target), f in edges.items():
            self.next.setdefault(source, {})[target] = f
            self.next.setdefault(target, {}).setdefault(source, f.inverse())

    def compositions(self, source: str) -> dict[str, Affine]:
        """The function from source to every unit it reaches, breadth first."""
        found, queue = {source: Affine(1.0)}, deque([source])
        while queue:
            at = queue.popleft()
            for unit, f in self.next.get(at, {}).items():
                if unit not in found:
                    found[unit] = found[at].then(f)
                    queue.append(unit)
        return found

    def check_cycles(self, tolerance: float = 1e-6) -> None:
        """Every edge must agree with the shortest composition between its ends, so every cycle is the identity."""
        for source in self.next:
            found = self.compositions(source)
            for at, f in found.items():
                for unit, step in self.next[at].items():
                    way, straight = f.then(step), found[unit]
                    if abs(way.a - straight.a) > tolerance * abs(straight.a) or abs(way.b - straight.b) > tolerance * max(1.0, abs(straight.b)):
                        raise ValueError(f"conversions {source} -> {at} -> {unit} and {source} -> {unit} differ")
