"""Constraint checking: shapes say what the nodes of a class must look like.

All constraints of a class are one aggregation: what is said about its nodes is read once, doubles are dropped, and for each node every constraint
keeps a small state (counts and flags), which partial aggregation adds up wherever the rows are, so that a hub's values don't
meet in one task.  A node without any value has its states, too, so a missing value is found like a surplus one.  States become
findings at the end.  A constraint's severity defaults to Violation, even in a shape of warnings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..sources.lift import Graph

FINDING = ["severity", "type", "focus", "path", "message"]


def _at(path: str) -> Column:
    return F.col("name") == path


@dataclass(frozen=True)
class Count:
    """Between least and most distinct values (or edge targets) of a path."""

    path: str
    least: int = 0
    most: int | None = None
    severity: str = "Violation"

    @property
    def paths(self) -> tuple[str, ...]:
        return (self.path,)

    def states(self) -> list[Column]:
        return [F.count_if(_at(self.path))]

    def findings(self, n: Column) -> list[tuple[Column, str]]:
        """How often each message stands against a node with these states."""
        few = [((n < self.least).cast("int"), f"fewer than {self.least} values")] if self.least else []
        return few if self.most is None else [*few, ((n > self.most).cast("int"), f"more than {self.most} values")]


@dataclass(frozen=True)
class Each:
    """Every value of a path meets a condition, a function of the value's column; unknown counts as unmet.  Each unmet value is a finding."""

    path: str
    condition: Callable[[Column], Column]
    says: str
    severity: str = "Violation"

    @property
    def paths(self) -> tuple[str, ...]:
        return (self.path,)

    def states(self) -> list[Column]:
        return [F.count_if(_at(self.path) & ~F.coalesce(self.condition(F.col("value")), F.lit(False)))]

    def findings(self, n: Column) -> list[tuple[Column, str]]:
        return [(n.cast("int"), self.says)]


def one_of(path: str, options: list[str], severity: str = "Violation") -> Each:
    return Each(path, lambda v: v.isin(options), "value not in the list", severity)


def pattern(path: str, regex: str, severity: str = "Violation") -> Each:
    """The pattern is searched for, not matched against the whole."""
    return Each(path, lambda v: v.rlike(regex), f"value without {regex}", severity)


def length(path: str, least: int, severity: str = "Violation") -> Each:
    return Each(path, lambda v: F.char_length(v) >= least, f"shorter than {least}", severity)


def between(path: str, low: float | None = None, high: float | None = None, severity: str = "Violation") -> Each:
    def inside(v: Column) -> Column:
        number = v.try_cast("double")
        return (number >= low if low is not None else number.isNotNull()) & (number <= high if high is not None else number.isNotNull())

    return Each(path, inside, f"not within {low}..{high}", severity)


@dataclass(frozen=True)
class HasValue:
    """Some value of a path is the given one, or with wanted=False none is."""

    path: str
    value: str
    wanted: bool = True
    severity: str = "Violation"

    @property
    def paths(self) -> tuple[str, ...]:
        return (self.path,)

    def states(self) -> list[Column]:
        return [F.count_if(_at(self.path) & (F.col("value") == self.value))]

    def findings(self, n: Column) -> list[tuple[Column, str]]:
        return [((n == 0 if self.wanted else n > 0).cast("int"), f"{'lacks' if self.wanted else 'has'} {self.value}")]


@dataclass(frozen=True)
class ExactlyOne:
    """Exactly one of several paths has a value."""

    paths: tuple[str, ...]
    severity: str = "Violation"
    path: str = ""

    def states(self) -> list[Column]:
        return [F.count_if(_at(p)) for p in self.paths]

    def findings(self, *held: Column) -> list[tuple[Column, str]]:
        n = sum(((h > 0).cast("int") for h in held), F.lit(0))
        return [((n != 1).cast("int"), f"not exactly one of {', '.join(self.paths)}")]


@dataclass(frozen=True)
class Query:
    """violating maps a graph to rows (focus, message); it is a plan of its own.

    The message may be a template: {column} stands for that column of a row, for each name in `bound`.
    """

    path: str
    violating: Callable[[Graph], DataFrame]
    severity: str = "Violation"
    message: str | None = None
    bound: tuple[str, ...] = ()

    def check(self, graph: Graph, targets: DataFrame) -> DataFrame:
        rows = self.violating(graph)
        if self.message is not None:
            text = F.lit(self.message)
            for name in self.bound:
                text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
            rows = rows.withColumn("message", text)
        return rows.select("focus", "message").join(targets, "focus", "left_semi")


@dataclass(frozen=True)
class Shape:
    type: str
    constraints: tuple


def _checked(graph: Graph, type_: str, constraints: list) -> DataFrame:
    """Findings of the constraints of a class that states decide."""
    names = sorted({p for c in constraints for p in c.paths})
    states, found = [], []
    for c in constraints:
        own = c.states()
        columns = [F.col(f"s{len(states) + k}") for k in range(len(own))]
        states += [s.alias(f"s{len(states) + k}") for k, s in enumerate(own)]
        for times, message in c.findings(*columns):
            finding = F.struct(F.lit(c.severity).alias("severity"), F.lit(c.path or ", ".join(c.paths)).alias("path"), F.lit(message).alias("message"))
            found.append(F.array_repeat(finding, times))
    said = graph.statements_of(type_, names).distinct()
    nodes = said.groupBy("focus").agg(F.count_if(F.col("name").isNull()).alias("is"), *states).where(F.col("is") > 0)
    return nodes.select("focus", F.explode(F.flatten(F.array(*found))).alias("f")).select("f.severity", F.lit(type_).alias("type"), "focus", "f.path", "f.message")


def check(graph: Graph, shapes: list[Shape]) -> DataFrame:
    """severity, type, focus, path and message of every finding: one aggregation for each class, whatever the number of its shapes and constraints."""
    parts, by_class = [], {}
    for s in shapes:
        by_class.setdefault(s.type, []).extend(s.constraints)
    for type_, constraints in by_class.items():
        if plain := [c for c in constraints if not isinstance(c, Query) and (not isinstance(c, Count) or c.least or c.most is not None)]:
            parts.append(_checked(graph, type_, plain))
        for c in constraints:
            if isinstance(c, Query):
                targets = graph.nodes_of([type_]).select(F.col("id").alias("focus"))
                parts.append(c.check(graph, targets).select(F.lit(c.severity).alias("severity"), F.lit(type_).alias("type"), "focus", F.lit(c.path).alias("path"), "message"))
    if not parts:
        return graph.spark.createDataFrame([], ", ".join(f"{c} string" for c in FINDING))
    return reduce(DataFrame.unionByName, parts)


def grouped(findings: DataFrame, examples: int = 5) -> DataFrame:
    """Findings by severity, type, path and message: n, and the first few subjects in order.

    The findings are written once, as both halves read them; a group's subjects are limited before they are gathered.
    """
    key, findings = ["severity", "type", "path", "message"], cut(findings)
    n = findings.groupBy(*key).agg(F.count("*").alias("n"))
    first = findings.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("focus"))).where(F.col("k") <= examples)
    return n.join(first.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("focus")), ",").alias("subjects")), key)


def conforms(findings: DataFrame) -> DataFrame:
    """One row: status blocked (violations), incomplete (warnings only) or complete, and both counts."""
    v, w = F.count_if(F.col("severity") == "Violation"), F.count_if(F.col("severity") != "Violation")
    return findings.agg(v.alias("violations"), w.alias("warnings")).withColumn("status", F.when(F.col("violations") > 0, "blocked").when(F.col("warnings") > 0, "incomplete").otherwise("complete"))
