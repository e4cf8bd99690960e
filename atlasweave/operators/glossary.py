"""Cards of vocabulary terms: what a term means, what refers to it, which questions ask about it, and the state of a history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import atlas, ledger


def cards(terms: DataFrame) -> DataFrame:
    """term, kind, definition, domain, range, properties (of which it is in the domain) and referenced_by (in whose range it is).

    terms(term, kind, definition, domain array, range array); unions are spread over their members.
    """
    spread = lambda side, name: terms.select(F.explode(side).alias("term"), F.col("term").alias("property")).groupBy("term").agg(F.array_sort(F.collect_set("property")).alias(name))
    rows = terms.join(spread("domain", "properties"), "term", "left").join(spread("range", "referenced_by"), "term", "left")
    nothing = F.array().cast("array<string>")
    return rows.select("term", "kind", "definition", "domain", "range", F.coalesce("properties", nothing).alias("properties"), F.coalesce("referenced_by", nothing).alias("referenced_by"))


def asked_by(terms: DataFrame, questions: DataFrame, prefix: str = "CQ") -> DataFrame:
    """term and question: where questions(question, uses array) name it, or its definition cites them as in "[CQ1, CQ4-6]"."""
    named = questions.select(F.explode("uses").alias("term"), "question").join(terms.select("term"), "term", "left_semi")
    cited = atlas.ranges(terms.select(F.col("term").alias("id"), F.col("definition").alias("text")), prefix)
    return named.unionByName(cited.select(F.col("id").alias("term"), F.col("cited").alias("question"))).distinct()


def listing(questions: DataFrame, briefs: DataFrame) -> DataFrame:
    """question, params, has_gaps and tasks for questions(question, params, has_gaps) and briefs(task, question)."""
    tasks = briefs.groupBy("question").agg(F.array_join(F.array_sort(F.collect_set("task")), ",").alias("tasks"))
    return questions.join(tasks, "question", "left").select("question", "params", "has_gaps", F.coalesce("tasks", F.lit("")).alias("tasks"))


def history_state(changes: DataFrame, current: DataFrame) -> DataFrame:
    """scope, revisions, last and pending (facts that differ from the last revision; null without any revision)."""
    known = changes.groupBy("scope").agg(F.countDistinct("revision").alias("revisions"), F.max("at").alias("last"))
    pending = ledger.diff(ledger.replay(changes), current).groupBy("scope").agg(F.count("*").alias("pending"))
    rows = current.select("scope").distinct().join(known, "scope", "full_outer").join(pending, "scope", "left")
    return rows.select("scope", F.coalesce("revisions", F.lit(0).cast("long")).alias("revisions"), "last", F.when(F.col("revisions").isNotNull(), F.coalesce("pending", F.lit(0).cast("long"))).alias("pending"))


def rank_terms(names: DataFrame, uses: DataFrame, k: int) -> DataFrame:
    """The k terms of names(term) that uses(term) hold most often; unused ones count 0; ties by term."""
    n = uses.groupBy("term").agg(F.count("*").alias("n"))
    return names.select("term").distinct().join(n, "term", "left").select("term", F.coalesce("n", F.lit(0).cast("long")).alias("n")).orderBy(F.desc("n"), "term").limit(k)
