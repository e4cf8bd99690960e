"""Accepting changes of vocabularies: the contract as last accepted, what has changed since, and who accepted what and when.

The accepted terms, version numbers and the changelog are one published version, so the log and the contract never differ, and of two people who accept at
once the second is refused and has to look again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import digest_of
from ..functions.lineage import cut
from ..sources import versions
from . import contract

TERM_COLUMNS = ["term", "kind", "domain", "range", "inverse", "label", "definition"]
NOTE_COLUMNS = ["term", "rationale", "alternatives", "validated_by", "validated_on"]
LOG = "at timestamp, by string, subject string, change string, severity string"


class AcceptRefused(ValueError):
    """A version number doesn't match its changes, or nobody is named."""


@dataclass(frozen=True)
class Contract:
    """terms(vocabulary, TERM_COLUMNS, NOTE_COLUMNS) and numbers(vocabulary, version)."""

    terms: DataFrame
    numbers: DataFrame


@dataclass(frozen=True)
class Review:
    """What has changed since the accepted version (None if there is none): changes(vocabulary, subject, change, severity), problems and confirmations to renew."""

    base: versions.Version | None
    changes: DataFrame
    problems: DataFrame
    reconfirm: DataFrame


def changes_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """vocabulary, subject, change and severity of all terms and notes."""
    found = contract.term_changes(old.select(TERM_COLUMNS), new.select(TERM_COLUMNS)).unionByName(contract.notes_changed(old.select(NOTE_COLUMNS), new.select(NOTE_COLUMNS)))
    owner = old.select("term", "vocabulary").unionByName(new.select("term", "vocabulary")).distinct()
    return found.join(owner, "term").select("vocabulary", F.col("term").alias("subject"), "change", "severity")


def to_reconfirm(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """subject, change, validated_by and validated_on of terms whose meaning has changed under a confirmation that is still the old one.

    A change that breaks or adds counts, and another definition; what was confirmed is the old text.
    """
    meaning = changes.where((F.col("severity") != contract.COSMETIC) | (F.col("change") == "definition")).select("subject", "change")
    confirmed = lambda t: t.where("validated_by IS NOT NULL").select(F.col("term").alias("subject"), "validated_by", "validated_on")
    a, b = confirmed(old).withColumnRenamed("validated_on", "before"), confirmed(new)
    same = a.join(b, ["subject", "validated_by"]).where("before <=> validated_on").drop("before")
    return meaning.join(same, "subject").distinct()


def review(spark: SparkSession, store: str, new: Contract) -> Review:
    """The contract against the one that was accepted last."""
    base = versions.current(spark, store)
    if base is None:
        nothing = spark.createDataFrame([], "vocabulary string, subject string, change string, severity string")
        return Review(None, nothing, nothing.select("vocabulary", F.lit("").alias("problem")), nothing.select("subject", "change", F.lit("").alias("validated_by"), F.lit("").alias("validated_on")))
    old, was = base.read(spark, "terms"), base.read(spark, "numbers")
    changes = cut(changes_between(old, new.terms))
    both = was.withColumnRenamed("version", "old").join(new.numbers.withColumnRenamed("version", "new"), "vocabulary")
    gate = contract.version_gate(changes.select("vocabulary", "severity"), both).where("NOT ok")
    back = contract.version_parts(F.col("new")) < contract.version_parts(F.col("old"))
    problem = F.when(back, F.concat(F.lit("went back from "), "old", F.lit(" to "), "new")).otherwise(F.concat(F.lit("is "), "new", F.lit(", but a change is "), "worst", F.lit(": at least "), "required"))
    return Review(base, changes, gate.select("vocabulary", problem.alias("problem")), to_reconfirm(old, new.terms, changes))


def accept(spark: SparkSession, store: str, new: Contract, by: str, at: str, seen: Review | None = None) -> versions.Version | None:
    """Publish the contract and its changelog as accepted; None if there is nothing to accept.

    Refuses (AcceptRefused) an unnamed person, and version numbers below what the changes need.  With a review that was seen before, the
    contract is accepted against that one's base, so that a change which came in between is a Conflict.
    """
    if not by or by.startswith("<"):
        raise AcceptRefused("name the person who accepts the changes")
    seen = seen or review(spark, store, new)
    if problems := [f"{r.vocabulary} {r.problem}" for r in seen.problems.orderBy("vocabulary").limit(20).collect()]:
        raise AcceptRefused("; ".join(problems))
    stamp = (F.lit(at).cast("timestamp").alias("at"), F.lit(by).alias("by"))
    if seen.base is None:
        entry = new.terms.groupBy("vocabulary").agg(F.count("*").alias("n")).select(*stamp, F.col("vocabulary").alias("subject"), F.concat(F.lit("first accepted, terms: "), F.col("n").cast("string")).alias("change"), F.lit(contract.ADDITIVE).alias("severity"))
        log = entry
    else:
        entry = seen.changes.select(*stamp, "subject", "change", "severity")
        if seen.changes.isEmpty():
            return None
        log = seen.base.read(spark, "changelog").unionByName(entry)
    terms = cut(new.terms.select("vocabulary", *TERM_COLUMNS, *NOTE_COLUMNS[1:]))
    tables = {"terms": versions.Table(terms), "numbers": versions.Table(new.numbers.select("vocabulary", "version")), "changelog": versions.Table(log)}
    return versions.publish(spark, store, tables, seen.base, {"accepted_by": by, "accepted_at": at, "digest": digest_of(terms)})


def changelog(spark: SparkSession, store: str) -> DataFrame:
    """at, by, subject, change and severity of everything that was ever accepted."""
    version = versions.current(spark, store)
    return version.read(spark, "changelog") if version else spark.createDataFrame([], LOG)
