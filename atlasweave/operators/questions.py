"""Questions with an answer and a gaps query, evaluated for every parameter value at once; briefs over them.

A question's status tells an empty answer from a complete one: a gap outranks an empty answer, which outranks an answer.
The parameter is a group key, so one job serves all parameter values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lift import Graph


@dataclass(frozen=True)
class Question:
    """answer and gaps map a graph to rows with the column `param`; gate says when an answer counts."""

    id: str
    answer: Callable[[Graph], DataFrame]
    gaps: Callable[[Graph], DataFrame] | None = None
    #: non_empty: an empty answer is a failure; gaps_only: only gaps are; any: nothing is; empty: rows are findings.
    gate: str = "non_empty"


def status(question: Question, graph: Graph, params: DataFrame) -> DataFrame:
    """param, question, answers, gaps and status for each of params(param)."""
    answers = question.answer(graph).groupBy("param").agg(F.count("*").alias("answers"))
    gaps = question.gaps(graph).groupBy("param").agg(F.count("*").alias("gaps")) if question.gaps else None
    rows = params.select("param").distinct().join(answers, "param", "left")
    rows = rows.join(gaps, "param", "left") if gaps is not None else rows.withColumn("gaps", F.lit(0).cast("long"))
    n, g = F.coalesce("answers", F.lit(0).cast("long")), F.coalesce("gaps", F.lit(0).cast("long"))
    if question.gate == "empty":
        verdict = F.when(n > 0, "violated").otherwise("clean")
    elif question.gate == "any":
        verdict = F.lit("answered")
    elif question.gate == "gaps_only":
        verdict = F.when(g > 0, "gap").otherwise("answered")
    else:
        verdict = F.when(g > 0, "gap").when(n == 0, "empty").otherwise("answered")
    return rows.select("param", F.lit(question.id).alias("question"), n.alias("answers"), g.alias("gaps"), verdict.alias("status"))


def statuses(questions: list[Question], graph: Graph, params: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [status(q, graph, params) for q in questions])


@dataclass(frozen=True)
class Brief:
    """A task is ready for a parameter value if all required questions are answered."""

    task: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()


def readiness(found: DataFrame, briefs: list[Brief]) -> DataFrame:
    """param, task, verdict and blockers (required questions without an answer) from statuses()."""
    rows = []
    for b in briefs:
        blocked = F.when(F.col("question").isin(*b.required) & ~F.col("status").isin("answered", "clean"), F.col("question"))
        per = found.groupBy("param").agg(F.array_join(F.array_sort(F.collect_set(blocked)), ", ").alias("blockers"))
        rows.append(per.select("param", F.lit(b.task).alias("task"), F.when(F.col("blockers") == "", "READY").otherwise("BLOCKED").alias("verdict"), "blockers"))
    return reduce(DataFrame.unionByName, rows)


def readiness_matrix(found: DataFrame, briefs: list[Brief]) -> DataFrame:
    """One row for each parameter value, one column for each task."""
    return readiness(found, briefs).groupBy("param").pivot("task", [b.task for b in briefs]).agg(F.first("verdict"))
