"""Rules that derive edges, to a fixpoint where they are recursive, and policies that flag rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..sources.lift import Graph


@dataclass(frozen=True)
class Derive:
    """when maps a graph to rows (src, dst), which become edges of the relation."""

    id: str
    rel: str
    when: Callable[[Graph], DataFrame]


@dataclass(frozen=True)
class Policy:
    """when maps a graph to rows (subject, message)."""

    id: str
    severity: str
    when: Callable[[Graph], DataFrame]


def derived(graph: Graph, rules: list[Derive]) -> DataFrame:
    """Distinct edges that the rules add to the graph as it is."""
    parts = [r.when(graph).select("src", F.lit(r.rel).alias("rel"), "dst") for r in rules]
    return reduce(DataFrame.unionByName, parts).distinct()


def fixpoint(graph: Graph, rules: list[Derive], most: int = 64) -> Graph:
    """The graph with all derivable edges: rounds until none is new, each round's edges written to the checkpoint folder."""
    edges = cut(graph.edges.distinct())
    for _ in range(most):
        new = cut(derived(graph.with_edges(edges), rules).join(edges, ["src", "rel", "dst"], "left_anti"))
        if new.isEmpty():
            return graph.with_edges(edges)
        edges = cut(edges.unionByName(new))
    raise RuntimeError(f"no fixpoint after {most} rounds")


def closure(pairs: DataFrame, most: int = 64) -> DataFrame:
    """Transitive closure of pairs(src, dst), semi-naive: each round extends only the last round's new pairs.  Cycles end."""
    step = cut(pairs.select("src", "dst").distinct())
    total, delta = step, step
    for _ in range(most):
        grown = delta.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        delta = cut(grown.join(total, ["src", "dst"], "left_anti"))
        if delta.isEmpty():
            return total
        total = cut(total.unionByName(delta))
    raise RuntimeError(f"no closure after {most} rounds")


def findings(graph: Graph, policies: list[Policy]) -> DataFrame:
    """policy, severity, subject and message of every flagged row."""
    parts = [p.when(graph).select(F.lit(p.id).alias("policy"), F.lit(p.severity).alias("severity"), "subject", "message") for p in policies]
    return reduce(DataFrame.unionByName, parts)
