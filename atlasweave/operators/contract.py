"""Change control of a vocabulary: what changed between two versions, how severe it is, and what it affects."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAKING, ADDITIVE, COSMETIC = "breaking", "additive", "cosmetic"


def _both(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    a = old.select(*key, F.struct(*[c for c in old.columns if c not in key]).alias("old"))
    b = new.select(*key, F.struct(*[c for c in new.columns if c not in key]).alias("new"))
    return a.join(b, key, "full_outer")


def _differs(name: str) -> Column:
    return ~F.col(f"old.{name}").eqNullSafe(F.col(f"new.{name}"))


def _covers(name: str) -> Column:
    """The new set holds all of the old one."""
    return F.size(F.array_except(F.coalesce(f"old.{name}", F.array().cast("array<string>")), F.coalesce(f"new.{name}", F.array().cast("array<string>")))) == 0


def term_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """term, change and severity for terms(term, kind, domain array, range array, inverse, label, definition).

    A removed term, another kind, or a domain or range that loses a member breaks users; a new term, a widened
    domain or range, or another inverse adds; another label or definition is cosmetic.  If both have a column parents (array):
    other superclasses of a class break, other superproperties of a property add.
    """
    parents = "parents" in old.columns and "parents" in new.columns
    both = _both(old, new, ["term"])
    out = (lambda change, severity, condition: F.when(condition, F.struct(F.lit(change).alias("change"), F.lit(severity).alias("severity"))))
    there = F.col("old").isNotNull() & F.col("new").isNotNull()
    found = [
        out("removed", BREAKING, F.col("new").isNull()),
        out("added", ADDITIVE, F.col("old").isNull()),
        out("kind", BREAKING, there & _differs("kind")),
        *[out(f"{n} narrowed", BREAKING, there & ~_covers(n)) for n in ("domain", "range")],
        *[out(f"{n} widened", ADDITIVE, there & _covers(n) & (F.size(F.array_except(f"new.{n}", f"old.{n}")) > 0)) for n in ("domain", "range")],
        out("inverse", ADDITIVE, there & _differs("inverse")),
        *[out(n, COSMETIC, there & _differs(n)) for n in ("label", "definition")],
    ]
    if parents:
        other = there & ~F.array_sort(F.coalesce("old.parents", F.array().cast("array<string>"))).eqNullSafe(F.array_sort(F.coalesce("new.parents", F.array().cast("array<string>"))))
        found += [out("superclass", BREAKING, other & (F.col("new.kind") == "class")), out("subproperty", ADDITIVE, other & ~F.col("new.kind").eqNullSafe("class"))]
    return both.select("term", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("c")).select("term", "c.*")


#: What is noted about a term: the name of the note, the column that says whether there is one, and all columns that are watched.
NOTES = (("reasoning", "rationale", ("rationale", "alternatives")), ("confirmation", "validated_by", ("validated_by", "validated_on")))


def notes_changed(old: DataFrame, new: DataFrame, key: str = "term") -> DataFrame:
    """key, change and severity (always cosmetic) of what is in both versions, for tables (key, rationale, alternatives, validated_by, validated_on).

    A note (its reasoning, its confirmation) is added, withdrawn or revised.
    """
    holds = lambda side, column: F.length(F.coalesce(F.col(f"{side}.{column}"), F.lit(""))) > 0
    found = []
    for name, lead, watched in NOTES:
        moved = reduce(or_, map(_differs, watched))
        verb = F.when(~holds("new", lead) & holds("old", lead), "withdrawn").when(holds("old", lead), "revised").otherwise("added")
        found.append(F.when(moved, F.concat(F.lit(f"{name} "), verb)))
    both = _both(old, new, [key]).where("old IS NOT NULL AND new IS NOT NULL")
    return both.select(key, F.explode(F.array_compact(F.array(*found))).alias("change"), F.lit(COSMETIC).alias("severity"))


def by_severity(changes: DataFrame, *then: str) -> DataFrame:
    """Changes in order: breaking, additive, cosmetic, then any other severity, then by the named columns."""
    rank = F.array_position(F.array(*map(F.lit, (BREAKING, ADDITIVE, COSMETIC))), F.col("severity"))
    return changes.orderBy(F.when(rank > 0, rank).asc_nulls_last(), *then)


def shape_changes(old: DataFrame, new: DataFrame, new_classes: DataFrame | None = None) -> DataFrame:
    """shape, change and severity for shapes(shape, target, constraint, argument, level, message).

    Adding, removing or changing a violation breaks (unless the target class is itself new); warnings add; wording is cosmetic.
    """
    both = _both(old, new, ["shape", "constraint"])
    level = F.coalesce("new.level", "old.level")
    fresh = F.lit(False)
    if new_classes is not None:
        both = both.join(new_classes.select(F.col("class").alias("__class"), F.lit(True).alias("__new")), F.coalesce("new.target", "old.target") == F.col("__class"), "left")
        fresh = F.coalesce("__new", F.lit(False))
    change = (
        F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(_differs("argument") | _differs("level"), "changed").when(_differs("target"), "target").when(_differs("message"), "message")
    )
    severity = F.when(F.col("change") == "message", COSMETIC).when((level == "Violation") & ~fresh, BREAKING).otherwise(ADDITIVE)
    return both.withColumn("change", change).where("change IS NOT NULL").withColumn("severity", severity).select("shape", "constraint", "change", "severity")


def question_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """question, change and severity for questions(question, params array, columns array, digest, wording)."""
    both = _both(old, new, ["question"])
    there = F.col("old").isNotNull() & F.col("new").isNotNull()
    lost, gained = ~_covers("columns"), F.size(F.array_except("new.columns", "old.columns")) > 0
    change = (
        F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(there & _differs("params"), "params").when(there & lost, "columns removed").when(there & gained, "columns added").when(there & _differs("digest"), "rewritten").when(there & _differs("wording"), "wording")
    )
    severity = F.when(F.col("change").isin("removed", "params", "columns removed"), BREAKING).when(F.col("change") == "wording", COSMETIC).otherwise(ADDITIVE)
    return both.withColumn("change", change).where("change IS NOT NULL").withColumn("severity", severity).select("question", "change", "severity")


def version_parts(version: Column) -> Column:
    """(major, minor, patch) of a version's text."""
    parts = F.split(version, r"\.")
    return F.struct(*[F.coalesce(F.get(parts, k).try_cast("int"), F.lit(0)).alias(n) for k, n in enumerate(("major", "minor", "patch"))])


def version_gate(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """vocabulary, old, new, worst, required and ok from changes(vocabulary, severity) and versions(vocabulary, old, new).

    Breaking changes need a new major version, additive ones a minor, cosmetic ones a patch; before 1.0 each is one place lower.
    """
    rank = F.min(F.when(F.col("severity") == BREAKING, 0).when(F.col("severity") == ADDITIVE, 1).otherwise(2))
    worst = changes.groupBy("vocabulary").agg(rank.alias("rank"))
    rows = versions.join(worst, "vocabulary", "left").withColumn("o", version_parts(F.col("old"))).withColumn("n", version_parts(F.col("new")))
    place = F.when(F.col("rank").isNull(), 3).otherwise(F.least(F.col("rank") + F.when(F.col("o.major") == 0, 1).otherwise(0), F.lit(2)))
    required = (
        F.when(place == 0, F.concat_ws(".", F.col("o.major") + 1, F.lit(0), F.lit(0)))
        .when(place == 1, F.concat_ws(".", "o.major", F.col("o.minor") + 1, F.lit(0)))
        .when(place == 2, F.concat_ws(".", "o.major", "o.minor", F.col("o.patch") + 1))
        .otherwise(F.col("old"))
    )
    named = F.when(F.col("rank") == 0, BREAKING).when(F.col("rank") == 1, ADDITIVE).when(F.col("rank") == 2, COSMETIC).otherwise("none")
    return rows.withColumn("required", required).select("vocabulary", "old", "new", named.alias("worst"), "required", (F.col("n") >= version_parts(F.col("required"))).alias("ok"))


def impact(changes: DataFrame, uses: DataFrame) -> DataFrame:
    """term, change and n: how many rows of uses(term) each breaking change affects."""
    n = uses.groupBy("term").agg(F.count("*").alias("n"))
    return changes.where(F.col("severity") == BREAKING).join(n, "term", "left").select("term", "change", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def coverage(items: DataFrame) -> DataFrame:
    """group, total, reasoned, validated and share of items(group, rationale, validated_by)."""
    counted = items.groupBy("group").agg(F.count("*").alias("total"), F.count_if(F.length(F.trim("rationale")) > 0).alias("reasoned"), F.count_if(F.col("validated_by").isNotNull()).alias("validated"))
    return counted.withColumn("share", F.round(F.col("reasoned") / F.col("total"), 4))


def unconfirmed(items: DataFrame) -> DataFrame:
    """item and problem where a confirmation names who but not when, the reverse, or no ISO date."""
    who, when = F.col("validated_by"), F.col("validated_on")
    problem = F.when(who.isNotNull() & when.isNull(), "no date").when(who.isNull() & when.isNotNull(), "no person").when(~when.rlike(r"^\d{4}-\d{2}-\d{2}$") | when.try_cast("date").isNull() & when.isNotNull(), "not a date")
    return items.withColumn("problem", problem).where("problem IS NOT NULL").select("item", "problem")


def undeclared(used: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms in use that the vocabulary doesn't declare."""
    return used.select("term").distinct().join(terms.select("term"), "term", "left_anti")


def clashes(units: DataFrame) -> DataFrame:
    """term, units and kind (clash, refinement) of terms(unit, term, definition) that several composed units define."""
    found = units.groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("unit")), ",").alias("units"), F.countDistinct("unit").alias("n"), F.countDistinct("definition").alias("d"))
    return found.where("n > 1").select("term", "units", F.when(F.col("d") > 1, "clash").otherwise("shared").alias("kind"))
