"""Nested documents from a graph: nodes of a class with their linked nodes as sorted lists, innermost first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lift import Graph


@dataclass(frozen=True)
class Follow:
    """A list of the nodes that a relation leads to (direction out) or comes from (in), each with lists of its own.

    attrs are literals to show (the least value where there are several); where keeps nodes by (property, = or !=, value), a
    missing value differing from any; sort names properties that order the list before label and id; first gives the first
    node instead of a list, or null; optional leaves the field out if the graph doesn't have the relation.
    """

    name: str
    rel: str
    direction: str = "out"
    follows: tuple[Follow, ...] = ()
    type: str | None = None
    attrs: tuple[str, ...] = ()
    where: tuple[tuple[str, str, str], ...] = ()
    sort: tuple[str, ...] = ()
    first: bool = False
    optional: bool = False


def _has(graph: Graph, rel: str) -> bool:
    named = graph.parts.get("edges")
    return rel in named if named else not graph.edges_of([rel]).isEmpty()


def _with_values(nodes: DataFrame, graph: Graph, preds: dict[str, str]) -> DataFrame:
    """nodes with a column for each property; preds gives the properties' columns."""
    if not preds:
        return nodes
    least = [F.min(F.when(F.col("pred") == p, F.col("value"))).alias(c) for p, c in preds.items()]
    values = graph.literals_of(list(preds)).groupBy(F.col("subj").alias("id")).agg(*least)
    return nodes.join(values, "id", "left")


def _documents(nodes: DataFrame, graph: Graph, follows: tuple[Follow, ...]) -> DataFrame:
    """nodes(id, label) with one array column for each relation followed."""
    rows = nodes
    for f in follows:
        if f.optional and not _has(graph, f.rel):
            continue
        near, far = ("src", "dst") if f.direction == "out" else ("dst", "src")
        ends = graph.nodes_of([f.type]) if f.type else graph.nodes
        asked = dict.fromkeys([*f.attrs, *(w[0] for w in f.where), *f.sort])
        asked = {p: f"__{i}" for i, p in enumerate(asked)}
        inner = _documents(_with_values(ends.select("id", "label"), graph, asked), graph, f.follows)
        for pred, how, value in f.where:
            same = F.col(asked[pred]).eqNullSafe(F.lit(value))
            inner = inner.where(same if how == "=" else ~same)
        links = graph.edges_of([f.rel]).select(F.col(near).alias("__near"), F.col(far).alias("__far")).distinct()
        item = F.struct("label", "id", *[F.col(asked[p]).alias(p) for p in f.attrs], *[x.name for x in f.follows if x.name in inner.columns])
        item = F.struct(F.struct(*[asked[p] for p in f.sort], F.lit(0)).alias("by"), item.alias("item"))
        linked = links.join(inner, F.col("__far") == F.col("id")).groupBy("__near")
        if f.first:
            found = linked.agg(F.min(item)["item"].alias(f.name))
        else:
            found = linked.agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias(f.name))
        rows = rows.join(found, F.col("id") == F.col("__near"), "left").drop("__near")
        if not f.first:
            rows = rows.withColumn(f.name, F.coalesce(f.name, F.array().cast(found.schema[f.name].dataType)))
    return rows


def project(graph: Graph, type: str, follows: tuple[Follow, ...], attrs: tuple[str, ...] = ()) -> DataFrame:
    """id, label, the asked literals and the followed lists of every node of a class."""
    nodes = _with_values(graph.nodes_of([type]).select("id", "label"), graph, {p: f"__{i}" for i, p in enumerate(attrs)})
    return _documents(nodes.select("id", "label", *[F.col(f"__{i}").alias(p) for i, p in enumerate(attrs)]), graph, follows)


def as_json(documents: DataFrame) -> DataFrame:
    """id and the document as JSON text."""
    return documents.select("id", F.to_json(F.struct(*documents.columns)).alias("document"))
