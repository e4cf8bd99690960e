"""Overview of a catalogue, and what in it has gone stale."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lift import Graph


def by_class(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("type").agg(F.count("*").alias("n"))


def by_property(graph: Graph) -> DataFrame:
    """Edges by relation and values by property."""
    edges = graph.edges.groupBy(F.col("rel").alias("property")).agg(F.count("*").alias("n"))
    return edges.unionByName(graph.literals.groupBy(F.col("pred").alias("property")).agg(F.count("*").alias("n")))


def top(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def shared_values(graph: Graph, pred: str) -> DataFrame:
    """Values of a property that several nodes have, with how many."""
    held = graph.literals_of([pred]).groupBy("value").agg(F.countDistinct("subj").alias("n"))
    return held.where("n > 1")


def stale(kinds: dict[str, DataFrame], today: str, days: int) -> DataFrame:
    """kind, subject and age of everything in kinds (name to rows of subject, at) that is older than some days."""
    age = F.datediff(F.lit(today).cast("date"), F.col("at").cast("date"))
    parts = [rows.select(F.lit(kind).alias("kind"), "subject", age.alias("age")) for kind, rows in kinds.items()]
    return reduce(DataFrame.unionByName, parts).where(F.col("age") > days)


def longest_prefix(names: DataFrame, known: DataFrame) -> DataFrame:
    """name and the longest known(prefix) that it begins with, by whole dotted segments: an equi-join on each name's prefixes."""
    parts = F.split("name", r"\.")
    prefixes = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("prefix"))
    return prefixes.join(known.select("prefix").distinct(), "prefix").groupBy("name").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def mentions(texts: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """id and every distinct match of a pattern in texts(id, text)."""
    return texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("found")).distinct()


def ranges(citations: DataFrame, prefix: str) -> DataFrame:
    """id and cited for texts such as "[Q1, Q4-6]": single references and ranges, spread out."""
    one = citations.select("id", F.explode(F.regexp_extract_all("text", F.lit(rf"{prefix}(\d+(?:-\d+)?)"), F.lit(1))).alias("r"))
    low, high = F.split("r", "-")[0].cast("int"), F.get(F.split("r", "-"), F.size(F.split("r", "-")) - 1).cast("int")
    return one.select("id", F.explode(F.sequence(low, F.greatest(low, high))).alias("k")).select("id", F.concat(F.lit(prefix), F.col("k").cast("string")).alias("cited")).distinct()


def share(part: Column, whole: Column) -> Column:
    return F.round(part / whole, 4)
