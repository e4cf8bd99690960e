"""Recursive rules over a property graph, evaluated by what is new.

A rule derives edges of a relation from the solutions of a pattern.  Rules are put in strata by the relations that they read: what a rule negates must be
finished before it starts, so a cycle through a negation is an error.  Within a stratum a first round evaluates every rule; from then on
a rule is evaluated once for each of its clauses on a relation that grew, with the new edges in that clause's place, so a round costs in
proportion to what the last one found.  Each round's new edges are written once to the shared folder and never again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..sources.lift import Graph
from .patterns import Edge, Either, Maybe, NotEdge, match

#: New edges that are sent to all executors at most.
BROADCAST_ROWS = 1 << 18


@dataclass(frozen=True)
class Rule:
    """Solutions of the body give edges of the relation `rel` from the variable src to the variable dst."""

    id: str
    rel: str
    body: tuple
    src: str = "src"
    dst: str = "dst"


class CycleThroughNegation(ValueError):
    """A relation depends on its own absence."""


def _reads(clauses: Sequence, negated: bool = False) -> set[tuple[str, bool]]:
    """(relation, whether it must be finished) of every edge that clauses read; optional groups and unions need theirs finished, too."""
    found: set[tuple[str, bool]] = set()
    for c in clauses:
        if isinstance(c, Edge):
            found |= {(r, negated) for r in c.rel.split("|")}
        elif isinstance(c, NotEdge):
            found |= {(r, True) for r in c.rel.split("|")}
        elif isinstance(c, Maybe):
            found |= _reads(c.clauses, True)
        elif isinstance(c, Either):
            found = found.union(*(_reads(b, True) for b in c.branches.values()))
    return found


def strata(rules: Sequence[Rule]) -> list[list[Rule]]:
    """The rules in the order that they are evaluated in: all of a relation are in one stratum, above what they negate."""
    derived = sorted({r.rel for r in rules})
    level = dict.fromkeys(derived, 0)
    for _ in range(len(derived) + 1):
        moved = False
        for rule in rules:
            for rel, finished in _reads(rule.body):
                if rel in level and level[rule.rel] < level[rel] + finished:
                    level[rule.rel], moved = level[rel] + finished, True
        if not moved:
            return [[r for r in rules if level[r.rel] == n] for n in sorted(set(level.values()))]
    raise CycleThroughNegation(f"among {', '.join(derived)} a relation depends on its own absence")


class Layers(Graph):
    """A graph with further edges: the layers of each derived relation, and one relation's new edges under another name."""

    def __init__(self, base: Graph, layers: dict[str, list[DataFrame]], new: dict[str, DataFrame] | None = None) -> None:
        super().__init__(parts={k: v for k, v in base.parts.items() if k != "statements"}, spark=base.spark)
        self._whole = base._whole
        self.base, self.layers, self.new = base, layers, new or {}

    def edges_of(self, rels: list[str]) -> DataFrame:
        found = [x for r in rels for x in ([self.new[r]] if r in self.new else self.layers.get(r, []))]
        base = held(self.base, plain) if (plain := [r for r in rels if r not in self.new]) else None
        return reduce(DataFrame.unionByName, found + [base] * (base is not None)) if found or base is not None else self.base._empty("edges")

    @property
    def edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [x for layer in self.layers.values() for x in layer], self.base.edges)


def held(graph: Graph, rels: list[str]) -> DataFrame | None:
    """The edges of the relations that a graph has of itself; None if it has none of them as parts."""
    parts = graph.parts.get("edges")
    return graph.edges_of(rels) if parts is None or any(r in parts for r in rels) else None


def variants(rule: Rule, grown: set[str]) -> list[tuple[tuple, str]]:
    """For each clause on a relation that grew: the body with that clause on the new edges alone, and the relation."""
    found = []
    for i, c in enumerate(rule.body):
        if isinstance(c, Edge):
            for rel in c.rel.split("|"):
                if rel in grown:
                    found.append(((*rule.body[:i], replace(c, rel=f"new {rel}"), *rule.body[i + 1 :]), rel))
    return found


@dataclass
class Derived:
    """The graph with all derived edges, the new ones of each round, and how many they were."""

    graph: Layers
    rounds: list[tuple[str, int]]

    def edges_of(self, rel: str) -> DataFrame:
        """The edges of a relation that rules have added."""
        layers = self.graph.layers.get(rel, [])
        return reduce(DataFrame.unionByName, layers) if layers else self.graph.base.edges_of([])


def evaluate(graph: Graph, rules: Sequence[Rule], most: int = 256, subclasses: dict[str, list[str]] | None = None) -> Derived:
    """All edges that the rules derive, each once and none that the graph has already."""
    layers: dict[str, list[DataFrame]] = {}
    rounds: list[tuple[str, int]] = []

    def solved(body: tuple, rule: Rule, on: Graph) -> DataFrame:
        return match(on, body, subclasses=subclasses).select(F.col(rule.src).alias("src"), F.lit(rule.rel).alias("rel"), F.col(rule.dst).alias("dst"))

    def add(parts: list[DataFrame], rels: list[str]) -> dict[str, DataFrame]:
        """What is new in parts becomes a layer of its relation; the edges that are known are compared once, where they are if what was found is little."""
        key = ["src", "rel", "dst"]
        found = reduce(DataFrame.unionByName, parts).distinct()
        known = [x.select(*key) for x in (held(graph, rels), *(x for r in rels for x in layers.get(r, []))) if x is not None]
        new = cut(found.join(reduce(DataFrame.unionByName, known), key, "left_anti") if known else found)
        counts = {r.rel: r.n for r in new.groupBy("rel").agg(F.count("*").alias("n")).collect()}  # a row for each relation
        rounds.extend(sorted(counts.items()))
        grown = {}
        for rel, n in counts.items():
            layer = new.where(F.col("rel") == rel) if len(counts) > 1 else new
            layers.setdefault(rel, []).append(layer)
            grown[f"new {rel}"] = F.broadcast(layer) if n <= BROADCAST_ROWS else layer
        return grown

    for stratum in strata(rules):
        rels = sorted({r.rel for r in stratum})
        new = add([solved(r.body, r, Layers(graph, layers)) for r in stratum], rels)
        for _ in range(most):
            grown = {name.removeprefix("new ") for name in new}
            parts = [solved(body, r, Layers(graph, layers, new)) for r in stratum for body, _ in variants(r, grown)]
            if not parts:
                break
            new = add(parts, rels)
        else:
            raise RuntimeError(f"no end of {', '.join(rels)} after {most} rounds")
    return Derived(Layers(graph, layers), rounds)
