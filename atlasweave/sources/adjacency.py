"""A graph written for look-ups by node: every edge at both of its ends, and nodes with their label and type.

Folders go by a hash of the node and files are sorted by it, so the edges of a few nodes are read from few folders and row groups.  The
edges of a hub are spread over several files by the rest of the order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import versions
from .lift import Graph

#: Folders; nodes that a scan is filtered by; nodes that are sent to all executors at most (more are joined by a shuffle).
BUCKETS, FEW, SENT = 32, 1 << 6, 1 << 18


def bucket_of(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int")


def tables(graph: Graph, slices: int = 1) -> dict[str, versions.Table]:
    """The tables to publish: links (both directions, once each), nodes and values; the rows of some folders at a time with several slices."""
    # made distinct once the order has brought equal ones together
    out, into = (graph.edges_repeated.select(F.col(a).alias("node"), F.lit(side).alias("side"), "rel", F.col(b).alias("other")) for a, b, side in (("src", "dst", "out"), ("dst", "src", "in")))
    nodes = graph.nodes.select(F.col("id").alias("node"), "label", "type")
    values = graph.literals.select(F.col("subj").alias("node"), "pred", "value")
    table = lambda rows, *order, gathered=None: versions.Table(rows.select(bucket_of(F.col("node")).alias("bucket"), *rows.columns), ("bucket",), order, gathered, versions.dealt(F.col("bucket"), slices))
    return {"links": table(out.unionByName(into), "node", "side", "rel", "other", gathered=DataFrame.distinct), "nodes": table(nodes, "node", "type", "label"), "values": table(values, "node", "pred", "value")}


@dataclass(frozen=True)
class Adjacency:
    spark: SparkSession
    version: versions.Version

    def of(self, name: str, nodes: list[str]) -> DataFrame:
        """Rows of a few nodes: only their folders are opened, and within files only the row groups that may hold them."""
        return self.version.read(self.spark, name).where(F.col("bucket").isin([bucket_of(F.lit(n)) for n in nodes]) & F.col("node").isin(nodes)).drop("bucket")

    def at(self, name: str, frontier: DataFrame) -> DataFrame:
        """Rows of the nodes of frontier(node): by their ids if they are few, else by a join."""
        first = [r.node for r in frontier.limit(FEW + 1).collect()]
        if len(first) <= FEW:
            return self.of(name, first)
        buckets = [r.bucket for r in frontier.select(bucket_of(F.col("node")).alias("bucket")).distinct().collect()]  # BUCKETS rows at most
        rows = self.version.read(self.spark, name).where(F.col("bucket").isin(buckets)).drop("bucket")
        return rows.join(_sent(frontier), "node")

    def met(self, frontier: DataFrame, direction: str, rel: str | None) -> DataFrame:
        """The links of the nodes of frontier(node)."""
        links = self.at("links", frontier)
        if direction != "both":
            links = links.where(F.col("side") == direction)
        return links.where(F.col("rel") == rel) if rel else links


def _sent(rows: DataFrame) -> DataFrame:
    """rows, to be sent to all executors by a join if they are few enough."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def publish(spark: SparkSession, folder: str, graph: Graph, base: versions.Version | None = None, slices: int = 1) -> Adjacency:
    """Write a graph; each slice reads it again and leaves a share of its shuffles on disk."""
    return Adjacency(spark, versions.publish(spark, folder, tables(graph, slices), base))


def open_adjacency(spark: SparkSession, folder: str) -> Adjacency:
    version = versions.current(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no graph has been published in {folder}")
    return Adjacency(spark, version)


def hops(stored: Adjacency, starts: DataFrame, depth: int = 1, direction: str = "both", rel: str | None = None, most: int = 3) -> DataFrame:
    """As walk.hops: src, rel, dst and hop of every edge met within depth steps of starts(id)."""
    if direction not in ("out", "in", "both"):
        raise ValueError("direction is out, in or both")
    frontier = starts.select(F.col("id").alias("node")).distinct()
    seen, found = frontier, None
    for hop in range(1, max(1, min(depth, most)) + 1):
        out = F.col("side") == "out"
        ends = (F.when(out, F.col("node")).otherwise(F.col("other")).alias("src"), "rel", F.when(out, F.col("other")).otherwise(F.col("node")).alias("dst"))
        met = cut(stored.met(frontier, direction, rel).select(*ends, "other"))
        here = met.select("src", "rel", "dst", F.lit(hop).alias("hop"))
        found = here if found is None else found.unionByName(here)
        if hop < depth:
            frontier = cut(met.select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti"))
            seen = seen.unionByName(frontier)
    return found.groupBy("src", "rel", "dst").agg(F.min("hop").alias("hop"))


def degrees(stored: Adjacency) -> DataFrame:
    """id, kind (out, in), n and known: how many links every node has at each side, and how many nodes are at their other ends.

    A link counts once for each node of that id.  Ends that are no node, or several, are sought among the ids alone; only their own links are looked at from the other side.
    """
    links, one = stored.version.read(stored.spark, "links"), F.lit(1).cast("long")
    nodes = stored.version.read(stored.spark, "nodes").groupBy("node").agg(F.count("*").alias("m"))
    odd = cut(links.select("node").distinct().join(nodes, "node", "left").select("node", F.coalesce("m", F.lit(0).cast("long")).alias("m")).where("m <> 1"))
    mended = links.join(_sent(odd), "node").select(F.col("other").alias("id"), F.when(F.col("side") == "out", "in").otherwise("out").alias("kind"), (F.greatest("m", one) - 1).alias("n"), (F.col("m") - 1).alias("known"))
    return links.select(F.col("node").alias("id"), F.col("side").alias("kind"), one.alias("n"), one.alias("known")).unionByName(mended).groupBy("id", "kind").agg(F.sum("n").alias("n"), F.sum("known").alias("known"))


def entity_card(stored: Adjacency, nodes: list[str]) -> DataFrame:
    """As walk.entity_card, for a few nodes: kind (value, out, in), name, other end or value, its label and type."""
    nothing = F.lit(None).cast("string")
    values = stored.of("values", nodes).select(F.col("node").alias("id"), F.lit("value").alias("kind"), F.col("pred").alias("name"), F.col("value").alias("other"), nothing.alias("other_label"), nothing.alias("other_type"))
    links = stored.of("links", nodes).select(F.col("node").alias("id"), F.col("side").alias("kind"), F.col("rel").alias("name"), "other")
    ends = stored.at("nodes", links.select(F.col("other").alias("node")).distinct()).select(F.col("node").alias("other"), F.col("label").alias("other_label"), F.col("type").alias("other_type"))
    return values.unionByName(links.join(ends, "other", "left"))
