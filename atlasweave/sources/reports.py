"""Report definitions as a graph: rules that map each kind of fact to nodes, edges and literals.

A rule says which facts it is about (a pattern over their paths), and which node, edge or literal each gives.  In its
templates {r} is the report, {s} its data source, {1}, {2} are groups of the pattern and {v} is the fact's value; a value that is a list gives one row for
each element.  Nodes that several rules or reports name are one node.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .documents import read_facts
from .lift import Graph


@dataclass(frozen=True)
class Rule:
    """Facts of a file whose path (and value, if a pattern for it is given) match give (subject, name, object): a node's type and label, an edge or a literal."""

    kind: str
    file: str
    path: str
    subject: str
    name: str
    object: str = "{v}"
    value: str | None = None


FIELD, RELEASE, REVISION = "report/{r}/field/{1}", "report/{r}/release/current", "report/{r}/revision/{1}"


def _literals(file: str, prefix: str, subject: str, names: dict[str, str]) -> list[Rule]:
    return [Rule("literal", file, rf"{prefix}{path}", subject, pred) for path, pred in names.items()]


def _entries(file: str, path: str, whole: str, rel: str, entry: str, type_: str) -> list[Rule]:
    """Nodes for the named entries of a list, and their edges from the whole."""
    return [Rule("node", file, path, entry, type_), Rule("edge", file, path, whole, rel, entry)]


#: The terms of the report vocabulary that a path stands for.
RULES: tuple[Rule, ...] = (
    Rule("node", "report", r"report\.title", "report/{r}", "ReportType"),
    *_literals("report", r"report\.", "report/{r}", {"id": "reportId", "version": "version", "kind": "kind", "purpose": "purpose", "owner": "owner", "cadence": "cadence", "audience": "audience", "locales": "locale", "layout": "layout", "title": "label"}),
    *_entries("report", r"report\.parameters", "report/{r}", "hasParameter", "report/{r}/parameter/{v}", "Parameter"),
    Rule("literal", "report", r"report\.parameters", "report/{r}/parameter/{v}", "label"),
    *_literals("report", r"report\.parameters\.([^.]+)\.", "report/{r}/parameter/{1}", {"meaning": "definition"}),
    *_entries("report", "sections", "report/{r}", "hasSection", "report/{r}/section/{v}", "Section"),
    *_literals("report", r"sections\.([^.]+)\.", "report/{r}/section/{1}", {"purpose": "purpose", "present_when": "presentWhen"}),
    Rule("edge", "report", r"sections\.([^.]+)\.component", "report/{r}/section/{1}", "renderedBy", "component/{v}"),
    Rule("node", "report", r"sections\.[^.]+\.component", "component/{v}", "Component"),
    Rule("literal", "report", r"sections\.[^.]+\.component", "component/{v}", "label"),
    Rule("edge", "report", r"sections\.([^.]+)\.fields", "report/{r}/section/{1}", "hasField", "report/{r}/field/{v}"),
    Rule("edge", "report", r"sections\.([^.]+)\.fields", "report/{r}/field/{v}", "inSection", "report/{r}/section/{1}"),
    Rule("node", "report", r"fields\.([^.]+)\.type", FIELD, "Field", "{1}"),
    Rule("literal", "report", r"fields\.([^.]+)\.type", FIELD, "fieldId", "{1}"),
    Rule("edge", "report", r"fields\.([^.]+)\.type", FIELD, "inReport", "report/{r}"),
    *_literals("report", r"fields\.([^.]+)\.", FIELD, {"type": "fieldType", "aliases": "alias"}),
    *[
        rule
        for locale, definition, label in (("en", "meaning", r"label\.en"), ("fr", "meaning_fr", r"label\.fr"))
        for rule in (
            *[Rule("node", "report", rf"fields\.([^.]+)\.{p}", f"{FIELD}/meaning/{locale}", "FieldMeaning", locale) for p in (definition, label)],
            *[Rule("edge", "report", rf"fields\.([^.]+)\.{p}", FIELD, "hasMeaning", f"{FIELD}/meaning/{locale}") for p in (definition, label)],
            *[Rule("literal", "report", rf"fields\.([^.]+)\.{p}", f"{FIELD}/meaning/{locale}", "locale", locale) for p in (definition, label)],
            Rule("literal", "report", rf"fields\.([^.]+)\.{definition}", f"{FIELD}/meaning/{locale}", "definition"),
            Rule("literal", "report", rf"fields\.([^.]+)\.{label}", f"{FIELD}/meaning/{locale}", "label"),
        )
    ],
    Rule("node", "report", r"fields\.([^.]+)\.rules", FIELD + "/rule/{v}", "Rule"),
    Rule("edge", "report", r"fields\.([^.]+)\.rules", FIELD, "hasRule", FIELD + "/rule/{v}"),
    Rule("literal", "report", r"fields\.([^.]+)\.rules", FIELD + "/rule/{v}", "ruleText"),
    Rule("node", "lineage", r"table\.name", "report/{r}/table", "Table"),
    Rule("edge", "lineage", r"table\.name", "report/{r}", "readsTable", "report/{r}/table"),
    *_literals("lineage", r"table\.", "report/{r}/table", {"dataset": "dataset", "name": "tableName"}),
    Rule("edge", "lineage", r"source\.name", "report/{r}/table", "inDataSource", "datasource/{v}"),
    Rule("node", "lineage", r"source\.name", "datasource/{v}", "DataSource"),
    *_literals("lineage", r"source\.", "datasource/{s}", {"name": "label", "kind": "sourceKind", "database": "database"}),
    Rule("edge", "lineage", r"parameters\.([^.]+)", "report/{r}/parameter/{1}", "boundToColumn", "report/{r}/table/{v}"),
    *_literals("lineage", r"fields\.([^.]+)\.", FIELD, {"status": "lineageStatus", "note": "lineageNote"}),
    Rule("edge", "lineage", r"fields\.([^.]+)\.column", FIELD, "sourcedFrom", "report/{r}/table/{v}"),
    *[
        rule
        for p in (r"fields\.[^.]+\.column", r"parameters\.[^.]+")
        for rule in (Rule("node", "lineage", p, "report/{r}/table/{v}", "Column"), Rule("literal", "lineage", p, "report/{r}/table/{v}", "columnName"), Rule("edge", "lineage", p, "report/{r}/table/{v}", "inTable", "report/{r}/table"))
    ],
    Rule("node", "provenance", r"lifecycle\.(\d+)\.status", "report/{r}/status/{1}", "StatusChange"),
    Rule("edge", "provenance", r"lifecycle\.(\d+)\.status", "report/{r}", "hasStatusChange", "report/{r}/status/{1}"),
    Rule("literal", "provenance", r"lifecycle\.(\d+)\.status", "report/{r}/status/{1}", "order", "{1}"),
    *_literals("provenance", r"lifecycle\.(\d+)\.", "report/{r}/status/{1}", {"status": "lifecycleStatus", "by": "changedBy", "at": "at", "note": "note"}),
    *_entries("provenance", "source_reports", "report/{r}", "derivedFrom", "report/{r}/source/{v}", "SourceDocument"),
    *_literals("provenance", r"source_reports\.([^.]+)\.", "report/{r}/source/{1}", {"repo_url": "repoUrl", "sha256": "sha256", "role": "role", "reference_kind": "referenceKind", "received": "receivedOn", "page_kinds": "pageKind", "notes": "note"}),
    Rule("node", "provenance", "runs", "report/{r}/run/{v}", "Run"),
    Rule("edge", "provenance", r"runs\.([^.]+)\.inputs", "report/{r}/run/{1}", "usedSource", "report/{r}/source/{v}"),
    *_literals("provenance", r"runs\.([^.]+)\.", "report/{r}/run/{1}", {"flow": "flow", "flow_version": "flowVersion", "engine_version": "engineVersion", "started": "startedAt", "result": "result"}),
    Rule("node", "provenance", r"runs\.([^.]+)\.decisions\.(\d+)\.gate", "report/{r}/run/{1}/approval/{2}", "Approval"),
    Rule("edge", "provenance", r"runs\.([^.]+)\.decisions\.(\d+)\.gate", "report/{r}/run/{1}", "hasApproval", "report/{r}/run/{1}/approval/{2}"),
    *_literals("provenance", r"runs\.([^.]+)\.decisions\.(\d+)\.", "report/{r}/run/{1}/approval/{2}", {"gate": "gate", "decision": "decision", "reviewer": "reviewer", "at": "at"}),
    Rule("node", "provenance", r"template\.version", RELEASE, "TemplateRelease"),
    Rule("edge", "provenance", r"template\.version", "report/{r}", "releasedAs", RELEASE),
    *_literals("provenance", r"template\.", RELEASE, {"version": "version", "frozen": "frozen", "repo_url": "repoUrl"}),
    *_literals("manifest", "", RELEASE, {"engine_version": "engineVersion", "ontology_version": "ontologyVersion", "library_version": "libraryVersion", "assets_pending": "assetPending", "waiver": "waiver"}),
    Rule("literal", "manifest", r"files\.(.+)", RELEASE, "fileHash", "{1} {v}"),
    Rule("literal", "manifest", r"fonts\.([^.]+)\.file", RELEASE, "font", "{1}"),
    *[Rule("edge", "manifest", rf"{part}\.{key}", RELEASE, rel, RELEASE + f"/{part}") for part, key, rel in (("schedule", "cadence", "hasSchedule"), ("verify", "golden_static_ssim_min", "hasVerificationPolicy"), ("approval", "sample_rate", "hasApprovalPolicy"), ("publish", "path", "hasPublishPolicy"), ("observability", "run_log", "hasObservabilityPolicy"))],
    *[
        rule
        for part, names in {
            "schedule": {"cadence": "cadence", "run_on": "runOn", "as_of": "asOfRule", "calendar": "calendar", "timezone": "timezone"},
            "verify": {"golden_static_ssim_min": "goldenStaticSsimMin", "overflow_blocking": "overflowBlocking", "fidelity_min": "fidelityMin"},
            "approval": {"sample_rate": "sampleRate", "sample_min": "sampleMin", "full_review_after_release": "fullReviewAfterRelease", "reviewer_role": "reviewerRole"},
            "publish": {"path": "pathPattern", "formats": "publishFormat", "retention_days": "retentionDays"},
            "observability": {"deliver_within_hours": "deliverWithinHours", "max_failure_rate": "maxFailureRate", "alert": "alertRecipient", "run_log": "runLog"},
        }.items()
        for rule in _literals("manifest", rf"{part}\.", RELEASE + f"/{part}", names)
    ],
    Rule("edge", "manifest", r"parameters\.([^.]+)\..+", RELEASE, "hasParameter", "report/{r}/parameter/{1}"),
    *_literals("manifest", r"parameters\.([^.]+)\.", "report/{r}/parameter/{1}", {"values": "allowedValue", "from": "boundBy"}),
    Rule("edge", "manifest", r"parameters\.([^.]+)\.universe", "report/{r}/parameter/{1}", "universeQuery", "report/{r}/query/{v}"),
    Rule("literal", "lineage", r"queries\.([^.]+)\.sql", "report/{r}/query/{1}", "label", "{1}"),
    Rule("literal", "lineage", r"queries\.([^.]+)\.sql", "report/{r}/query/{1}", "sql"),
    Rule("node", "history", r"revisions\.(\d+)\.revision", REVISION, "Revision"),
    Rule("edge", "history", r"revisions\.(\d+)\.revision", "report/{r}", "hasRevision", REVISION),
    *_literals("history", r"revisions\.(\d+)\.", REVISION, {"revision": "order", "by": "changedBy", "at": "at", "why": "reason", "effective": "effectiveFrom"}),
    Rule("edge", "history", r"revisions\.(\d+)\.changes\.(\d+)\.fact", REVISION, "hasChange", REVISION + "/change/{2}"),
    *_literals("history", r"revisions\.(\d+)\.changes\.(\d+)\.", REVISION + "/change/{2}", {"fact": "fact", "kind": "changeKind", "from": "previousValue", "to": "newValue"}),
)


def filled(template: str, path: str) -> Column:
    """A template's text for a fact."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece == "{r}":
            parts.append(F.col("report"))
        elif piece == "{s}":
            parts.append(F.col("source"))
        elif piece == "{v}":
            parts.append(F.col("text"))
        elif re.fullmatch(r"\{\d\}", piece):
            parts.append(F.regexp_extract("fact", f"^{path}$", int(piece[1])))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def texts_of(facts: DataFrame) -> DataFrame:
    """One row for each scalar of a fact's value, with it as text; nulls and empty containers give none."""
    listed = F.from_json("value", "array<string>")
    scalar = F.when(F.startswith("value", F.lit('"')), F.get_json_object(F.concat(F.lit("["), "value", F.lit("]")), "$[0]")).otherwise(F.col("value"))
    values = F.when(F.startswith("value", F.lit("[")), listed).when(F.startswith("value", F.lit("{")) | (F.col("value") == "null"), F.array().cast("array<string>")).otherwise(F.array(scalar))
    return facts.select("*", F.explode(values).alias("text"))


def applied(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """scope, kind, subject, name and object that texts(scope, report, source, file, fact, text) state by rules, each once a scope; file is without its ending.

    Rules are keyed by their file and the first step of their path, so a fact meets only the few that can be about it.
    """
    groups: dict[tuple[str, str], list[Column]] = {}
    for r in rules:
        made = F.struct(F.lit(r.kind).alias("kind"), filled(r.subject, r.path).alias("subject"), F.lit(r.name).alias("name"), filled(r.object, r.path).alias("object"))
        fits = F.col("fact").rlike(f"^{r.path}$")
        groups.setdefault((r.file, re.match(r"\w*", r.path)[0]), []).append(F.when(fits if r.value is None else fits & F.col("text").rlike(f"^(?s:{r.value})$"), made))
    step, found = F.split("fact", r"\.")[0], None
    for (file, first), made in groups.items():
        mine = (F.col("file") == file) & (step == first)
        found = F.when(mine, F.array(*made)) if found is None else found.when(mine, F.array(*made))
    return texts.select("scope", F.explode(F.array_compact(found)).alias("x")).select("scope", "x.*").distinct()


def statements(facts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """scope, kind, subject, name and object that facts(scope, file, fact, value) of reports state, each once a scope."""
    named = lambda fact: F.max(F.when(F.col("fact") == fact, F.get_json_object(F.concat(F.lit("["), "value", F.lit("]")), "$[0]")))
    names = facts.groupBy("scope").agg(named("report.id").alias("report"), named("source.name").alias("source")).where("report IS NOT NULL")
    return applied(texts_of(facts.where("fact IS NOT NULL").join(names, "scope").withColumn("file", F.regexp_extract("file", r"^([^.]+)", 1))), rules)


def graph_of(stated: DataFrame) -> Graph:
    """The graph that statements(kind, subject, name, object) of several scopes make."""
    rows = stated.select("kind", "subject", "name", "object").distinct()
    labels = rows.where("kind = 'literal' AND name = 'label'").groupBy(F.col("subject").alias("id")).agg(F.min("object").alias("own"))
    nodes = rows.where("kind = 'node'").groupBy(F.col("subject").alias("id"), F.col("name").alias("type")).agg(F.min("object").alias("object"))
    nodes = nodes.join(labels, "id", "left").select("id", "type", F.coalesce("own", "object").alias("label"))
    edges = rows.where("kind = 'edge'").select(F.col("subject").alias("src"), F.col("name").alias("rel"), F.col("object").alias("dst"))
    literals = rows.where("kind = 'literal'").select(F.col("subject").alias("subj"), F.col("name").alias("pred"), F.col("object").alias("value"))
    return Graph(nodes, edges, literals)


def lift_facts(facts: DataFrame, rules: tuple[Rule, ...] = RULES) -> Graph:
    """The graph of facts(scope, file, fact, value)."""
    return graph_of(cut(statements(facts, rules)))


def left_out(facts: DataFrame, findings: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """scope, file and error of what can't be read, of second reports of one id (of two folders the first in order of names counts), and of invalid ones.

    findings maps facts to findings(scope, severity, file, path, message); errors leave their scope out, warnings don't.
    """
    ids = facts.where("fact = 'report.id'").select("scope", "value")
    first = ids.groupBy("value").agg(F.min("scope").alias("first"))
    second = ids.join(first, "value").where("scope <> first").select("scope", F.lit("report.yaml").alias("file"), F.lit("report id is taken").alias("error"))
    found = facts.where("error IS NOT NULL").select("scope", "file", "error").unionByName(second)
    if findings is not None:
        found = found.unionByName(findings(facts).where("severity = 'error'").select("scope", "file", F.concat_ws(" ", F.nullif("path", F.lit("")), "message").alias("error")))
    return found.distinct()


def read_reports(spark: SparkSession, folder: str, findings: Callable[[DataFrame], DataFrame] | None = None) -> tuple[Graph, DataFrame]:
    """The graph of all report folders, and skipped(scope, file, error); see left_out()."""
    facts = cut(read_facts(spark, folder))
    skipped = cut(left_out(facts, findings))
    return lift_facts(facts.join(skipped.select("scope").distinct(), "scope", "left_anti")), skipped


def lift_documents(documents: list[DataFrame]) -> Graph:
    """The graph of several tables of facts."""
    return lift_facts(reduce(DataFrame.unionByName, documents))
