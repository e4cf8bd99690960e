"""Conjunctive patterns over a property graph, as joins.

A pattern is a list of clauses that bind variables; each variable is a column of the result.  Clauses are joined in the order
given, on the variables they share; Catalyst and adaptive execution choose how.  Alternated relations and
types can bind the same nodes twice, so `match(..., dedup=True)` keeps distinct bindings, as question patterns ask for;
without it the bag of solutions is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lift import Graph


@dataclass(frozen=True)
class Node:
    """var is a node of one of the types ("A|B"), subclasses included if match() knows them."""

    var: str
    type: str


@dataclass(frozen=True)
class Edge:
    """An edge from one variable to another by one of the relations ("a|b"); "*" stands for any node."""

    src: str
    rel: str
    dst: str


@dataclass(frozen=True)
class NotEdge:
    """No such edge exists."""

    src: str
    rel: str
    dst: str


@dataclass(frozen=True)
class Value:
    """as_ is a value of var's property."""

    var: str
    pred: str
    as_: str


@dataclass(frozen=True)
class Label:
    """as_ is var's label; with a type ("A|B") only nodes of it are looked at."""

    var: str
    as_: str
    type: str | None = None


@dataclass(frozen=True)
class Maybe:
    """The whole group if it matches, else nulls."""

    clauses: tuple


@dataclass(frozen=True)
class Either:
    """Solutions of any branch, each tagged with its name in the column `tag`."""

    tag: str
    branches: dict[str, tuple]


@dataclass(frozen=True)
class Where:
    """A condition on bound variables; unknown counts as false."""

    condition: Column


def _on_shared(left: DataFrame | None, right: DataFrame, how: str, by: str | None = None) -> DataFrame:
    if left is None:
        return right
    shared = [c for c in right.columns if c in left.columns]
    if shared:
        return left.join(right.hint(by) if by else right, shared, how)
    # an optional group with no common variable goes with every solution, so it may have one solution at most
    if len(right.take(2)) > 1:
        raise ValueError(f"an optional group of several solutions shares no variable with what is bound: {', '.join(right.columns)}")
    return left.join(F.broadcast(right), F.lit(True), how)


def _edges(graph: Graph, c: Edge | NotEdge) -> DataFrame:
    found = graph.edges_of(c.rel.split("|")).select(F.col("src").alias("__a"), F.col("dst").alias("__b"))
    found = found.where("__a = __b") if c.src == c.dst != "*" else found
    kept = [F.col(x).alias(v) for x, v in (("__a", c.src), ("__b", c.dst)) if v != "*"]
    kept = kept[:1] if c.src == c.dst else kept
    return found.select(*kept).distinct() if "*" in (c.src, c.dst) or "|" in c.rel else found.select(*kept)


def variables(c) -> set[str]:
    """The variables that a clause names; those of a condition are unknown."""
    if isinstance(c, (Edge, NotEdge)):
        return {c.src, c.dst} - {"*"}
    if isinstance(c, Node):
        return {c.var}
    if isinstance(c, (Value, Label)):
        return {c.var, c.as_}
    if isinstance(c, Maybe):
        return set().union(*map(variables, c.clauses))
    if isinstance(c, Either):
        return {c.tag}.union(*(variables(x) for b in c.branches.values() for x in b))
    return set()


def _bound_by(c) -> set[str]:
    """The variables that every solution of a clause binds: of a union those of all its branches."""
    if isinstance(c, Either):
        return {c.tag} | set.intersection(*(set().union(*map(_bound_by, b)) for b in c.branches.values()))
    return set() if isinstance(c, Maybe) else variables(c)


def _joins(c, bound: set[str]) -> bool:
    """Whether a clause, and each branch of a union, shares a bound variable (or nothing is bound yet)."""
    if isinstance(c, Either):
        return not bound or all(bound & set().union(*map(variables, b)) for b in c.branches.values())
    return not bound or bool(bound & variables(c))


def _in_order(clauses: Sequence, bound: set[str]) -> list:
    """The clauses so that each required one shares a variable with those before it.

    An absent edge and a condition come right after the required clauses of their stretch (up to an optional group), as they
    only test what is bound.  Required clauses without a common variable would pair all their solutions: that is an error, and so is a required
    clause on a variable that only some branches of a union bind.
    """
    out, bound, partial, clauses = [], set(bound), set(), list(clauses)
    while clauses:
        end = next((i for i, c in enumerate(clauses) if isinstance(c, Maybe)), len(clauses))
        stretch, tests = [c for c in clauses[:end] if not isinstance(c, (NotEdge, Where))], [c for c in clauses[:end] if isinstance(c, (NotEdge, Where))]
        while stretch:
            found = next((c for c in stretch if _joins(c, bound)), None)
            if found is None:
                raise ValueError(f"no variable connects {stretch[0]!r} with the clauses before it")
            if unsure := (partial - bound) & variables(found):
                raise ValueError(f"only some branches of a union bind {', '.join(sorted(unsure))}, on which {found!r} would join")
            stretch.remove(found)
            out.append(found)
            bound |= _bound_by(found)
            partial |= variables(found)
        for c in tests:
            if not bound or isinstance(c, NotEdge) and not bound & variables(c):
                raise ValueError(f"nothing binds the variables of {c!r}")
        out += tests
        if end < len(clauses):
            out.append(clauses[end])
            bound |= variables(clauses[end])
        clauses = clauses[end + 1 :]
    return out


def _needs_outer(clauses: Sequence) -> bool:
    """Whether a group tests what is bound outside of it: it holds a condition, or nothing of its own comes before an absent edge."""
    own = set().union(*(variables(c) for c in clauses if not isinstance(c, (NotEdge, Where))))
    return any(isinstance(c, Where) or isinstance(c, NotEdge) and not own & variables(c) for c in clauses)


def _within(rows: DataFrame, inner: DataFrame, how: str) -> DataFrame:
    """rows joined with solutions that hold rows' own columns too, nulls included."""
    renamed = inner.toDF(*[f"__{c}" if c in rows.columns else c for c in inner.columns])
    same = [rows[c].eqNullSafe(renamed[f"__{c}"]) for c in rows.columns]
    return rows.join(renamed, same, how).drop(*[f"__{c}" for c in rows.columns])


def match(graph: Graph, clauses: Sequence, dedup: bool = False, subclasses: dict[str, list[str]] | None = None, bound: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """One row for each solution, one column for each variable; with bound, solutions that go on from its rows.

    by is Spark's hint for the joins on common variables: "merge" where all clauses have a row for nearly every node, as broadcasts are chosen by the size of
    files, and a table of keys takes many times more of the driver's memory.
    """
    rows: DataFrame | None = bound
    for c in _in_order(clauses, set(bound.columns) if bound is not None else set()):
        if isinstance(c, Node):
            types = sorted({t for name in c.type.split("|") for t in (name, *(subclasses or {}).get(name, ()))})
            rows = _on_shared(rows, graph.nodes_of(types).select(F.col("id").alias(c.var)), "inner", by)
        elif isinstance(c, Edge):
            rows = _on_shared(rows, _edges(graph, c), "inner", by)
        elif isinstance(c, NotEdge):
            rows = _on_shared(rows, _edges(graph, c), "left_anti", by)
        elif isinstance(c, Value):
            rows = _on_shared(rows, graph.literals_of([c.pred]).select(F.col("subj").alias(c.var), F.col("value").alias(c.as_)), "inner", by)
        elif isinstance(c, Label):
            rows = _on_shared(rows, (graph.nodes_of(c.type.split("|")) if c.type else graph.nodes).select(F.col("id").alias(c.var), F.col("label").alias(c.as_)), "inner", by)
        elif isinstance(c, Maybe):
            if rows is not None and _needs_outer(c.clauses):
                rows = _within(rows, match(graph, c.clauses, True, subclasses, rows.distinct(), by), "left")
            else:
                rows = _on_shared(rows, match(graph, c.clauses, dedup, subclasses, by=by), "left", by)
        elif isinstance(c, Either):
            parts = []
            for name, branch in c.branches.items():  # each branch joins on the variables that it binds itself
                outer = rows is not None and _needs_outer(branch)
                found = match(graph, branch, dedup or outer, subclasses, rows.distinct() if outer else None, by)
                found = _within(rows, found, "inner") if outer else _on_shared(rows, found, "inner", by)
                parts.append(found.withColumn(c.tag, F.lit(name)))
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        elif isinstance(c, Where):
            rows = rows.where(c.condition)
        else:
            raise TypeError(f"not a clause: {c!r}")
    return rows.distinct() if dedup else rows
