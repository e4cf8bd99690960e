"""Graph navigation: k-hop neighbourhoods and entity cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..sources.lift import Graph

#: Greatest depth, and rows that neighbors() reports at most (a feature of the report, flagged by `truncated`).
MAX_DEPTH, MAX_EDGES = 3, 500


def hops(graph: Graph, starts: DataFrame, depth: int = 1, direction: str = "both", rel: str | None = None) -> DataFrame:
    """src, rel, dst and hop of every edge met within depth steps of starts(id), by breadth-first rounds.

    An edge counts at the first round that meets it; a node is expanded once.  Edges are filtered before each join, and
    the frontier joins them on its own key, so a round shuffles the edges of the chosen relation at most once.
    """
    edges = graph.edges_of([rel]) if rel else graph.edges
    steps = []
    if direction in ("out", "both"):
        steps.append(edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "src", "rel", "dst"))
    if direction in ("in", "both"):
        steps.append(edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "src", "rel", "dst"))
    if not steps:
        raise ValueError("direction is out, in or both")
    step = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    frontier = starts.select(F.col("id").alias("at")).distinct()
    seen, found = frontier, None
    for hop in range(1, max(1, min(depth, MAX_DEPTH)) + 1):
        met = cut(frontier.join(step, "at"))
        here = met.select("src", "rel", "dst", F.lit(hop).alias("hop")).distinct()
        found = here if found is None else found.unionByName(here)
        frontier = met.select(F.col("to").alias("at")).distinct().join(seen, "at", "left_anti")
        seen = seen.unionByName(frontier)
    return found.groupBy("src", "rel", "dst").agg(F.min("hop").alias("hop"))


def neighbors(graph: Graph, starts: DataFrame, depth: int = 1, direction: str = "both", rel: str | None = None, limit: int = MAX_EDGES) -> DataFrame:
    """The first `limit` edges in order of src, rel, dst, and whether there are more."""
    found = hops(graph, starts, depth, direction, rel)
    first = found.orderBy("src", "rel", "dst").limit(limit)
    more = found.agg((F.count("*") > limit).alias("truncated"))
    return first.join(F.broadcast(more))  # one row


def entity_card(graph: Graph, starts: DataFrame) -> DataFrame:
    """kind (value, out, in), name, other end or value, its label and type, for each of starts(id)."""
    ends = graph.nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"), F.col("type").alias("other_type"))
    start = starts.select("id")
    values = start.join(graph.literals, F.col("id") == F.col("subj")).select("id", F.lit("value").alias("kind"), F.col("pred").alias("name"), F.col("value").alias("other"), F.lit(None).cast("string").alias("other_label"), F.lit(None).cast("string").alias("other_type"))
    out = start.join(graph.edges, F.col("id") == F.col("src")).select("id", F.lit("out").alias("kind"), F.col("rel").alias("name"), F.col("dst").alias("other"))
    into = start.join(graph.edges, F.col("id") == F.col("dst")).select("id", F.lit("in").alias("kind"), F.col("rel").alias("name"), F.col("src").alias("other"))
    linked = out.unionByName(into).join(ends, "other", "left")
    return values.unionByName(linked)
