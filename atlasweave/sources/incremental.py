"""A catalogue of definition folders that reads only what has changed.

A published version holds a manifest (each file's time and length), the facts and the statements of every folder.  A refresh compares the manifest
with the files as they are, parses the folders with a new, changed or removed file, replaces their rows and publishes the next version; where
nothing has changed nothing is read or written.  Which folders are left out is decided from the facts of all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import digest_of
from ..functions.lineage import cut
from . import reports, versions
from .documents import PATTERN, read_facts
from .lift import Graph

#: Changed files that are opened by their names; more are read with their whole catalogue and picked.
NAMED = 1 << 12
Findings = Callable[[DataFrame], DataFrame] | None
FACTS = "scope string, file string, fact string, value string, error string"


@dataclass(frozen=True)
class Catalogue:
    """The graph of all folders that count, skipped(scope, file, error), the version, how many files were parsed for it, and its graph's digest."""

    graph: Graph
    skipped: DataFrame
    version: versions.Version
    parsed: int

    @property
    def digest(self) -> str:
        return self.version.meta["digest"]


def scope_of(path: Column) -> Column:
    steps = F.split(path, "/")
    return F.when(F.element_at(steps, -2) == "semantic", F.element_at(steps, -3)).otherwise(F.element_at(steps, -2))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, scope, changed and length of all documents below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", PATTERN).load(folder)
    return found.select("path", scope_of(F.col("path")).alias("scope"), F.col("modificationTime").alias("changed"), "length")


def moved_scopes(old: DataFrame, new: DataFrame) -> DataFrame:
    """scope of every folder in which a file was added, changed or removed."""
    a, b = old.select("path", F.col("scope").alias("was"), F.struct("changed", "length").alias("old")), new.select("path", F.col("scope").alias("is"), F.struct("changed", "length").alias("new"))
    return a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select(F.coalesce("is", "was").alias("scope")).distinct()


def opened(spark: SparkSession, version: versions.Version, parsed: int, findings: Findings = None) -> Catalogue:
    """The catalogue of a version; statements of folders that are left out don't count."""
    skipped = cut(reports.left_out(version.read(spark, "facts"), findings))
    stated = version.read(spark, "statements").join(skipped.select("scope").distinct(), "scope", "left_anti")
    return Catalogue(reports.graph_of(stated), skipped, version, parsed)


def refresh(spark: SparkSession, folder: str, store: str, findings: Findings = None) -> Catalogue:
    """The catalogue as its files are now, without the folders that findings of facts forbid; Conflict if another refresh was faster."""
    base, now = versions.current(spark, store), cut(listed(spark, folder))
    if base is None:
        gone, files = None, now
    else:
        gone = cut(moved_scopes(base.read(spark, "manifest"), now))
        if gone.isEmpty():
            return opened(spark, base, 0, findings)
        files = now.join(F.broadcast(gone), "scope", "left_semi")
    parsed = files.count()
    if base is not None and parsed <= NAMED:
        paths = [r.path for r in files.select("path").collect()]
        facts = read_facts(spark, paths) if paths else spark.createDataFrame([], FACTS)
    else:
        facts = read_facts(spark, folder)
        facts = facts if gone is None else facts.join(gone, "scope", "left_semi")
    facts = cut(facts)
    stated = reports.statements(facts)
    if base is not None:
        kept = lambda name: base.read(spark, name).join(gone, "scope", "left_anti")
        facts, stated = kept("facts").unionByName(facts), kept("statements").unionByName(stated)
    stated = cut(stated)
    digest = digest_of(stated.select("kind", "subject", "name", "object").distinct())
    tables = {"manifest": versions.Table(now), "facts": versions.Table(facts), "statements": versions.Table(stated)}
    return opened(spark, versions.publish(spark, store, tables, base, {"digest": digest}), parsed, findings)
