"""Gated relational export of a graph, and its read side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lift import Graph


def node_rows(graph: Graph) -> DataFrame:
    """id, type, label and properties (JSON text, keys and values in order) of every node."""
    values = graph.literals.groupBy("subj", "pred").agg(F.array_sort(F.collect_set("value")).alias("values"))
    props = values.groupBy("subj").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pred", "values"))))).alias("properties"))
    return graph.nodes.join(props, graph.nodes["id"] == props["subj"], "left").select("id", "type", "label", F.coalesce("properties", F.lit("{}")).alias("properties"))


def edge_rows(graph: Graph) -> DataFrame:
    """Distinct source, property, target."""
    return graph.edges.select(F.col("src").alias("source"), F.col("rel").alias("property"), F.col("dst").alias("target")).distinct()


def dangling(graph: Graph) -> DataFrame:
    """Edges with an end that is no node, and which end."""
    ids = graph.nodes.select("id")
    bad_source = graph.edges.join(ids, F.col("src") == F.col("id"), "left_anti").withColumn("end", F.lit("source"))
    bad_target = graph.edges.join(ids, F.col("dst") == F.col("id"), "left_anti").withColumn("end", F.lit("target"))
    return bad_source.unionByName(bad_target)


class ExportRefused(ValueError):
    """The graph doesn't conform, so nothing was written."""


def export(graph: Graph, path: str, meta: dict[str, str], findings: DataFrame | None = None) -> None:
    """Write nodes, edges and meta as Parquet; refuses if a finding is a Violation or an error, or an edge dangles."""
    blocking = [] if findings is None else findings.where("severity IN ('Violation', 'error')").take(1)
    if blocking or dangling(graph).take(1):
        raise ExportRefused("fix the violations that the shape report and dangling() list, then export again")
    spark = graph.nodes.sparkSession
    node_rows(graph).write.mode("overwrite").parquet(f"{path}/nodes")
    edge_rows(graph).write.mode("overwrite").partitionBy("property").parquet(f"{path}/edges")
    spark.createDataFrame(sorted(meta.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "meta")}
