"""An append-only ledger of revisions with transaction and valid time.

changes(scope, revision, at, effective, fact, kind, value): kind is baseline, added, changed or removed; at is when a
revision was known, effective (default: at) from when it holds.  Replay applies revisions in the order of their numbers,
not of their effective dates.  Replay and diff are partial aggregations; integrity, lifecycle and last_set look at the rows before in
blocks (running.in_order), so no scope's or fact's whole history meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import in_order


def _visible(changes: DataFrame, as_of: Column | str | None, known_on: Column | str | None) -> DataFrame:
    rows = changes
    if as_of is not None:
        rows = rows.where(F.coalesce("effective", "at") <= as_of)
    if known_on is not None:
        rows = rows.where(F.col("at") <= known_on)
    return rows


def replay(changes: DataFrame, as_of: str | None = None, known_on: str | None = None) -> DataFrame:
    """scope, fact, value, revision as they held on a date, as far as was known on another.

    The visible change with the highest revision decides each fact; a visible baseline later than a fact's change resets it.
    """
    rows = _visible(changes, F.lit(as_of).cast("timestamp") if as_of else None, F.lit(known_on).cast("timestamp") if known_on else None)
    reset = rows.where("kind = 'baseline'").groupBy("scope").agg(F.max("revision").alias("reset"))
    last = rows.groupBy("scope", "fact").agg(F.max_by(F.struct("kind", "value"), "revision").alias("last"), F.max("revision").alias("revision"))
    kept = last.join(reset, "scope", "left").where("last.kind <> 'removed' AND (reset IS NULL OR revision >= reset)")
    return kept.select("scope", "fact", F.col("last.value").alias("value"), "revision")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """scope, fact, kind, old and new of every fact that was added, changed or removed."""
    old, new = before.select("scope", "fact", F.col("value").alias("old"), F.lit(True).alias("was")), after.select("scope", "fact", F.col("value").alias("new"), F.lit(True).alias("is"))
    both = old.join(new, ["scope", "fact"], "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select("scope", "fact", "kind", "old", "new")


def apply_diff(before: DataFrame, changes: DataFrame) -> DataFrame:
    """The facts after a diff: diff(before, apply_diff(before, d)) is d again."""
    kept = before.join(changes.select("scope", "fact"), ["scope", "fact"], "left_anti").select("scope", "fact", "value")
    return kept.unionByName(changes.where("kind <> 'removed'").select("scope", "fact", F.col("new").alias("value")))


def next_revision(changes: DataFrame, current: DataFrame, by: str, why: str | None, at: str, effective: str | None = None) -> DataFrame:
    """Rows to append so that replay gives the current facts: a baseline for a new scope, else the diff.

    It holds from effective (default: at).  Refuses (ValueError) an anonymous author, and a changed or removed fact without a reason.
    """
    if not by or by.startswith("<"):
        raise ValueError("name the person who makes the revision")
    pending = diff(replay(changes), current)
    if not why and pending.where("kind <> 'added'").take(1):
        raise ValueError("say why facts were changed or removed")
    numbers = changes.groupBy("scope").agg(F.max("revision").alias("last"))
    rows = pending.join(numbers, "scope", "left")
    return rows.select(
        "scope", (F.coalesce("last", F.lit(0)) + 1).alias("revision"), F.lit(at).cast("timestamp").alias("at"), F.lit(effective or at).cast("timestamp").alias("effective"), F.lit(by).alias("by"), F.lit(why).alias("why"),
        "fact", F.when(F.col("last").isNull(), "baseline").otherwise(F.col("kind")).alias("kind"), F.col("old").alias("previous"), F.col("new").alias("value"),
    )


def accept(changes: DataFrame, current: DataFrame, findings: DataFrame, by: str, why: str | None, at: str, effective: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows to append for the scopes that current has and no finding stands against, and the refused scopes with their number of findings.

    findings(scope, severity) are those of validation and of the shapes; errors and violations refuse a scope, others don't.  Scopes that
    current doesn't have are left as they are, and a scope without changes adds nothing.
    """
    asked = current.select("scope").distinct()
    refused = findings.where(F.lower("severity").isin("error", "violation")).groupBy("scope").agg(F.count("*").alias("findings")).join(asked, "scope", "left_semi")
    good = asked.join(refused, "scope", "left_anti")
    return next_revision(changes.join(good, "scope", "left_semi"), current.join(good, "scope", "left_semi"), by, why, at, effective), refused


def last_set(changes: DataFrame) -> DataFrame:
    """scope, fact, value and since: from when the current value has held (a baseline that repeats the value sets nothing anew)."""
    rows = in_order(changes, ["scope", "fact"], ["revision"], before={"was": "value", "had": "kind"})
    moved = rows.withColumn("same", (F.col("kind") == "baseline") & F.col("was").eqNullSafe(F.col("value")) & F.col("had").isNotNull())
    return moved.where("NOT same").groupBy("scope", "fact").agg(F.max_by("value", "revision").alias("value"), F.max_by("kind", "revision").alias("kind"), F.max_by("at", "revision").alias("since")).where("kind <> 'removed'").drop("kind")


def integrity(changes: DataFrame) -> DataFrame:
    """scope, revision, fact and problem of every violation of the ledger's rules.

    Revisions are numbered 1, 2, ... and their times don't go back; only the first is a baseline; a change starts from the
    value that is held (the column `previous`).
    """
    revisions = changes.groupBy("scope", "revision").agg(F.min("at").alias("at"), F.max(F.col("kind") == "baseline").alias("baseline"))
    numbered = in_order(revisions, ["scope"], ["revision"], place="place", highest={"latest": "at"})
    about = lambda problem, condition: numbered.where(condition).select("scope", "revision", F.lit(None).cast("string").alias("fact"), F.lit(problem).alias("problem"))
    before = in_order(changes.select("scope", "fact", "revision", "kind", "previous", "value"), ["scope", "fact"], ["revision"], before={"was": "kind", "had": "value"})
    wrong = before.withColumn("held", F.when(F.col("was") != "removed", F.col("had"))).where("kind <> 'baseline' AND NOT (previous <=> held)").select("scope", "revision", "fact", F.lit("doesn't start from the held value").alias("problem"))
    return about("number", "revision <> place").unionByName(about("time goes back", "at < latest")).unionByName(about("late baseline", "baseline AND place > 1")).unionByName(wrong)


def lifecycle(log: DataFrame, stages: list[str]) -> DataFrame:
    """scope, seq, status and problem of log(scope, seq, at, status) entries that break the order of stages.

    A log begins with the first stage, moves forward by one stage at a time (back by any), and its times don't go back.
    """
    rank = F.array_position(F.array(*map(F.lit, stages)), F.col("status")).cast("int")
    rows = in_order(log.withColumn("rank", rank), ["scope"], ["seq"], before={"before": "rank"}, highest={"earlier": "at"})
    problem = (
        F.when(F.col("rank") == 0, "unknown status").when(F.col("before").isNull() & (F.col("rank") != 1), "first status").when(F.col("rank") > F.col("before") + 1, "skips a status").when(F.col("at") < F.col("earlier"), "time goes back")
    )
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select("scope", "seq", "status", "problem")


def unfrozen(log: DataFrame, releases: DataFrame, stage: str = "in_production") -> DataFrame:
    """Scopes whose log ends at a stage that needs a frozen release, without one among releases(scope, frozen)."""
    last = current_status(log).where(F.col("status") == stage)
    return last.join(releases.where("frozen"), "scope", "left_anti").select("scope", "seq", "status", F.lit("needs a frozen release").alias("problem"))


def current_status(log: DataFrame) -> DataFrame:
    """The last entry of each scope's log."""
    return log.groupBy("scope").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
