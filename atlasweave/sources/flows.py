"""Flow documents as a graph: steps, outcomes, checks, transitions, artifacts and parameters, with the references that stand inside texts.

A flow is a folder with `flow.json` (or .yaml), and may hold `bindings.json` (or .yaml) that says which concepts its artifacts carry and which checks
enforce its invariants:

    concepts: {<id>: {label, definition, artifacts: [<artifact>]}}
    invariants: {<id>: {statement, enforced_by: {<step>: [<check>]}}}

What a single value states comes from rules, as for reports; what depends on several values of a document (optional inputs, outcomes of transitions,
implementations, references in free text) is a join by folder and entry.  A reference `config.a.b.c` means the longest known parameter that
it begins with by whole steps; one without any stays as a parameter without a value and is reported.

Defined results: a folder whose flow can't be parsed, has no id, has an id that another folder has too (the first in order of names counts), or has
entries without different ids is left out and named; an outcome without description has an empty one; a list or flag as a parameter's value is its JSON
text; entries of a list of objects within the configuration are parameters of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .documents import read_facts, value_text
from .lift import Graph
from .reports import Rule, applied, graph_of, texts_of

FILES = "{flow,bindings}.{json,yaml,yml}"
#: The class of each type of step, and the keys of an action that count for each of its kinds.
STEP_CLASSES = {"deterministic": "DeterministicStep", "ocr": "OcrStep", "claude": "ClaudeStep", "human": "HumanStep", "terminal": "TerminalStep"}
ACTIONS = {
    "command": {"command": "command"},
    "claude": {"prompt_ref": "promptRef", "prompt_version": "promptVersion", "output_schema": "outputSchema", "writes_only": "writesOnly"},
    "human_review": {"review_page": "reviewPage", "decision_options": "decisionOption", "required_fields": "requiredField"},
}

ROOT, STEP, EDGE, ARTIFACT, CHECK = "flow/{r}", "flow/{r}/step/{1}", "flow/{r}/edge/{1}", "flow/{r}/artifact/{1}", "flow/{r}/step/{1}/check/{2}"
OUTCOME, METRIC, EFFECT = "flow/{r}/step/{1}/outcome/{2}", "flow/{r}/step/{1}/metric/{v}", "flow/{r}/edge/{1}/effect/{2}"
NODE, LINK, DONE = r"nodes\.([^.]+)\.", r"edges\.([^.]+)\.", r"artifacts\.([^.]+)\."
VALIDATION, OUTCOMES, EFFECTS = NODE + r"validations\.([^.]+)\.", NODE + r"outcomes\.(.+)", LINK + r"effects\.([^.]+)\."


def _values(prefix: str, subject: str, names: dict[str, str], file: str = "flow") -> list[Rule]:
    return [Rule("literal", file, prefix + key, subject, pred) for key, pred in names.items()]


#: The terms of the flow vocabulary that a path stands for.
RULES: tuple[Rule, ...] = (
    Rule("node", "flow", "id", ROOT, "Flow"),
    *_values("", ROOT, {"title": "label", "version": "value"}),
    Rule("node", "flow", r"phases\.([^.]+)\.title", "flow/{r}/phase/{1}", "Phase"),
    *_values(r"phases\.([^.]+)\.", "flow/{r}/phase/{1}", {"title": "label"}),
    Rule("edge", "flow", r"phases\.([^.]+)\.nodes", "flow/{r}/step/{v}", "inPhase", "flow/{r}/phase/{1}"),
    Rule("edge", "flow", r"entrypoints\.([^.]+)", "flow/{r}/phase/{1}", "entrypoint", "flow/{r}/step/{v}"),
    *[Rule("node", "flow", NODE + "type", STEP, class_, "{1}", value=type_) for type_, class_ in STEP_CLASSES.items()],
    Rule("edge", "flow", NODE + "type", ROOT, "hasStep", STEP),
    Rule("literal", "flow", NODE + "type", STEP, "stepId", "{1}"),
    Rule("literal", "flow", NODE + "type", STEP, "sourceRef", "flow.json#/nodes/{1}"),
    Rule("literal", "flow", NODE + "uses_ocr", STEP, "usesOcr", value="true"),
    *_values(NODE, STEP, {"name": "label", "description": "description", "foreach": "foreach", r"retry\.max_attempts": "retryMax"}),
    *[rule for names in ACTIONS.values() for rule in _values(NODE + r"action\.", STEP, names)],
    Rule("edge", "flow", NODE + "outputs", STEP, "writes", "flow/{r}/artifact/{v}"),
    Rule("edge", "flow", NODE + "metrics", STEP, "records", METRIC),
    Rule("node", "flow", NODE + "metrics", METRIC, "Metric"),
    Rule("literal", "flow", NODE + "metrics", METRIC, "metricName"),
    Rule("node", "flow", OUTCOMES, OUTCOME, "Outcome", "{2}"),
    Rule("literal", "flow", OUTCOMES, OUTCOME, "outcomeName", "{2}"),
    Rule("literal", "flow", OUTCOMES, OUTCOME, "description"),
    Rule("edge", "flow", OUTCOMES, STEP, "hasOutcome", OUTCOME),
    Rule("node", "flow", VALIDATION + "kind", CHECK, "Check", "{2}"),
    Rule("edge", "flow", VALIDATION + "kind", STEP, "hasCheck", CHECK),
    Rule("literal", "flow", VALIDATION + "kind", CHECK, "checkId", "{2}"),
    *_values(VALIDATION, CHECK, {"kind": "checkKind", "description": "description", "check": "expression", "blocking": "blocking"}),
    Rule("edge", "flow", VALIDATION + "on_fail", CHECK, "onFail", "flow/{r}/step/{1}/outcome/{v}"),
    Rule("node", "flow", DONE + "path", ARTIFACT, "Artifact", "{1}"),
    Rule("literal", "flow", DONE + "path", ARTIFACT, "label", "{1}"),
    Rule("literal", "flow", DONE + "path", ARTIFACT, "sourceRef", "flow.json#/artifacts/{1}"),
    Rule("literal", "flow", DONE + "optional", ARTIFACT, "optional", value="true"),
    *_values(DONE, ARTIFACT, {"path": "path", "format": "format", "description": "description", "schema": "outputSchema"}),
    Rule("node", "flow", DONE + "key_fields", ARTIFACT + "/field/{v}", "Field"),
    Rule("edge", "flow", DONE + "key_fields", ARTIFACT, "hasField", ARTIFACT + "/field/{v}"),
    Rule("literal", "flow", DONE + "key_fields", ARTIFACT + "/field/{v}", "fieldPath"),
    Rule("node", "flow", LINK + "from", EDGE, "Transition", "{1}"),
    Rule("edge", "flow", LINK + "from", EDGE, "from", "flow/{r}/step/{v}"),
    Rule("literal", "flow", LINK + "from", EDGE, "sourceRef", "flow.json#/edges/{1}"),
    Rule("edge", "flow", LINK + "to", EDGE, "to", "flow/{r}/step/{v}", value=r"[^$].*"),
    Rule("literal", "flow", LINK + "to", EDGE, "toDynamic", value=r"[$].*"),
    *_values(LINK, EDGE, {"description": "description", "priority": "priority", "guard": "guard"}),
    Rule("node", "flow", EFFECTS + "op", EFFECT, "Effect", "{2}"),
    Rule("edge", "flow", EFFECTS + "op", EDGE, "hasEffect", EFFECT),
    *_values(EFFECTS, EFFECT, {"op": "op"}),
    Rule("literal", "flow", EFFECTS + "path", EFFECT, "statePath", "state.{v}"),
    Rule("node", "bindings", r"concepts\.([^.]+)\.label", "flow/{r}/concept/{1}", "Concept"),
    *_values(r"concepts\.([^.]+)\.", "flow/{r}/concept/{1}", {"label": "label", "definition": "definition"}, "bindings"),
    Rule("edge", "bindings", r"concepts\.([^.]+)\.artifacts", "flow/{r}/artifact/{v}", "carries", "flow/{r}/concept/{1}"),
    Rule("node", "bindings", r"invariants\.([^.]+)\.statement", "flow/{r}/invariant/{1}", "Invariant", "{1}"),
    *_values(r"invariants\.([^.]+)\.", "flow/{r}/invariant/{1}", {"statement": "statement"}, "bindings"),
    Rule("edge", "bindings", r"invariants\.([^.]+)\.enforced_by\.([^.]+)", "flow/{r}/invariant/{1}", "enforcedBy", "flow/{r}/step/{2}/check/{v}"),
)

#: How texts name parameters, metrics and places of the state.
CONFIG, STATE, OWN_METRIC, OTHER_METRIC = r"config\.([A-Za-z_]\w*(?:\.\w+)*)", r"state\.(\w+(?:\.\w+)*)", r"(?<![\w.])metrics\.(\w+)", r"state\.nodes\.\w+\.metrics\.\w+"


@dataclass(frozen=True)
class Flows:
    """The graph of all flows that count, skipped(scope, file, error), and unresolved(flow, subject, rel, name): references to unknown parameters."""

    graph: Graph
    skipped: DataFrame
    unresolved: DataFrame


def _id(kind: str, *parts: str) -> Column:
    """flow/<flow>/<kind>/..., from columns; a part that begins with / is a text."""
    return F.concat(F.lit("flow/"), "report", F.lit(f"/{kind}/"), *[F.lit(p) if p.startswith("/") else F.col(p) for p in parts])


def _at(texts: DataFrame, path: str, *names: str) -> DataFrame:
    """scope, report, the groups of a path by their names, and the text of the flow's values there."""
    groups = [F.regexp_extract("fact", f"^{path}$", i).alias(n) for i, n in enumerate(names, 1)]
    return texts.where((F.col("file") == "flow") & F.col("fact").rlike(f"^{path}$")).select("scope", "report", *groups, "text")


def _found(rows: DataFrame, pattern: str) -> DataFrame:
    """rows, one for each different match of a pattern's group in their text, as `name`."""
    return rows.withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))))


def _as(kind: str, rows: DataFrame, subject: Column, name: Column | str, object_: Column) -> DataFrame:
    return rows.select("scope", F.lit(kind).alias("kind"), subject.alias("subject"), (F.lit(name) if isinstance(name, str) else name).alias("name"), object_.cast("string").alias("object"))


def resolved(names: DataFrame, known: DataFrame) -> DataFrame:
    """scope, name and the longest known(scope, prefix) that it begins with by whole steps, or null: an equi-join on each name's prefixes."""
    parts = F.split("name", r"\.")
    prefixes = names.select("scope", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("prefix"))
    hits = known.select("scope", "prefix", F.lit(True).alias("hit")).distinct()
    return prefixes.join(hits, ["scope", "prefix"], "left").groupBy("scope", "name").agg(F.max_by("prefix", F.when(F.col("hit"), F.length("prefix"))).alias("prefix"), F.max("hit").alias("hit")).select("scope", "name", F.when(F.col("hit"), F.col("prefix")).alias("prefix"))


def _checks(texts: DataFrame) -> DataFrame:
    """scope, report, step, check, text and blocking of the checks that compare metrics."""
    kinds = _at(texts, VALIDATION + "kind", "step", "check").where("text = 'metric'").drop("text")
    blocking = _at(texts, VALIDATION + "blocking", "step", "check").withColumnRenamed("text", "blocking")
    keys = ["scope", "report", "step", "check"]
    return _at(texts, VALIDATION + "check", "step", "check").join(kinds, keys).join(blocking, keys, "left")


def references(texts: DataFrame) -> DataFrame:
    """scope, report, subject, rel and name of every parameter that actions, checks and guards name."""
    check = _id("step", "step", "/check/", "check")
    parts = [
        _at(texts, NODE + r"action\.(.+)", "step", "key").select("scope", "report", _id("step", "step").alias("subject"), F.lit("usesParameter").alias("rel"), "text"),
        _checks(texts).select("scope", "report", check.alias("subject"), F.lit("comparedTo").alias("rel"), "text"),
        _at(texts, LINK + "guard", "edge").select("scope", "report", _id("edge", "edge").alias("subject"), F.lit("usesParameter").alias("rel"), "text"),
    ]
    return _found(reduce(DataFrame.unionByName, parts), CONFIG).drop("text").distinct()


def _of_parameters(facts: DataFrame, refs: DataFrame) -> list[DataFrame]:
    """Parameters with their values, and what refs(…, prefix) use."""
    config = facts.where("file = 'flow' AND value NOT LIKE '{%'").select("scope", "report", F.regexp_extract("fact", r"^config\.(.+)$", 1).alias("name"), "value").where("name <> ''")
    used = refs.withColumn("name", F.coalesce("prefix", "name"))
    every = config.select("scope", "report", "name").union(used.select("scope", "report", "name")).distinct()
    param = _id("param", "name")
    return [
        _as("node", every, param, "Parameter", F.col("name")),
        _as("literal", every, param, "paramName", F.col("name")),
        _as("literal", config, param, "value", value_text(F.col("value"))),
        _as("literal", config, param, "sourceRef", F.concat(F.lit("flow.json#/config/"), F.replace("name", F.lit("."), F.lit("/")))),
        _as("edge", used, F.col("subject"), F.col("rel"), param),
    ]


def _of_steps(texts: DataFrame, paths: DataFrame | None) -> list[DataFrame]:
    """Inputs, implementations and outcomes of transitions: what takes several values of a document."""
    keys = ["scope", "report", "step"]
    optional = _at(texts, NODE + "inputs_optional", "step").withColumn("optional", F.lit(True)).distinct()
    inputs = _at(texts, NODE + "inputs", "step").join(optional, [*keys, "text"], "left")
    done = _at(texts, NODE + r"action\.implemented", "step").withColumnRenamed("text", "done")
    steps = _at(texts, NODE + "type", "step").where("text <> 'terminal'").drop("text").join(done, keys, "left")
    script = F.get(F.split(F.trim("text"), r"\s+"), 1)
    runs = _at(texts, NODE + r"action\.command", "step").withColumn("script", script).where("script IS NOT NULL").withColumn("file", F.replace("script", F.lit("{skill_dir}/"), F.lit("")))
    impl = _id("impl", "file")
    made = [
        _as("edge", inputs, _id("step", "step"), F.when(F.col("optional"), "readsOptional").otherwise("reads"), _id("artifact", "text")),
        _as("literal", steps, _id("step", "step"), "isImplemented", F.coalesce(F.col("done") == "true", F.lit(False))),
        _as("node", runs, impl, "Implementation", F.col("file")),
        _as("literal", runs, impl, "path", F.col("script")),
        _as("edge", runs, _id("step", "step"), "implementedBy", impl),
    ]
    if paths is not None:
        homes = paths.where(F.col("path").rlike(r"/flow\.(json|ya?ml)$")).select(F.element_at(F.split("path", "/"), -2).alias("scope"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("home"))
        there = runs.join(homes, "scope").withColumn("path", F.concat("home", F.lit("/"), "file")).join(paths.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
        made.append(_as("literal", there, impl, "exists", F.coalesce("there", F.lit(False))))
    on = _at(texts, LINK + "on", "edge").select("scope", "report", "edge", F.col("text").alias("on"))
    moves = _at(texts, LINK + "from", "edge").withColumnRenamed("text", "step")
    known = _at(texts, NODE + "type", "step").select("scope", "report", F.col("step").alias("text"))
    made += [
        _as("edge", moves.join(on, ["scope", "report", "edge"]), _id("edge", "edge"), "onOutcome", _id("step", "step", "/outcome/", "on")),
        _as("literal", moves.join(_at(texts, LINK + "priority", "edge"), ["scope", "report", "edge"], "left_anti"), _id("edge", "edge"), "priority", F.lit(0)),
        _as("edge", _at(texts, DONE + "produced_by", "artifact").join(known, ["scope", "report", "text"], "left_semi"), _id("artifact", "artifact"), "producedBy", _id("step", "text")),
    ]
    return made


def _of_texts(texts: DataFrame) -> list[DataFrame]:
    """Metrics that checks measure, and places of the state that checks and guards read."""
    checks, check = _checks(texts), _id("step", "step", "/check/", "check")
    measured = _found(checks.withColumn("text", F.regexp_replace("text", OTHER_METRIC, "")), r"metrics\.(\w+)")
    metric = _id("step", "step", "/metric/", "name")
    read = _found(checks.withColumn("text", F.concat_ws(" ", "text", "blocking")), STATE)
    guards = _at(texts, LINK + "guard", "edge")
    own = _found(guards.join(_at(texts, LINK + "from", "edge").withColumnRenamed("text", "step"), ["scope", "report", "edge"]), OWN_METRIC)
    place = F.concat(F.lit("state."), "name")
    return [
        _as("node", measured, metric, "Metric", F.col("name")),
        _as("literal", measured, metric, "metricName", F.col("name")),
        _as("edge", measured, check, "measures", metric),
        _as("literal", read, check, "readsStatePath", place),
        _as("literal", _found(guards, STATE), _id("edge", "edge"), "readsStatePath", place),
        _as("literal", own, _id("edge", "edge"), "readsStatePath", F.concat(F.lit("state.nodes."), "step", F.lit(".metrics."), "name")),
    ]


def left_out(facts: DataFrame) -> DataFrame:
    """scope, file and error of folders that can't count; see the module's defined results."""
    ids = facts.where("file RLIKE '^flow[.]' AND fact = 'id'").select("scope", "file", "value")
    first = ids.groupBy("value").agg(F.min("scope").alias("first"))
    second = ids.join(first, "value").where("scope <> first").select("scope", "file", F.lit("flow id is taken").alias("error"))
    unnamed = facts.where("file RLIKE '^flow[.]' AND fact IS NOT NULL").select("scope", "file").distinct().join(ids.select("scope"), "scope", "left_anti").withColumn("error", F.lit("flow has no id"))
    repeated = facts.where("file RLIKE '^flow[.]' AND fact RLIKE '^(nodes|edges|phases)[.][^.]+[.]id$'").select("scope", "file", F.concat(F.split("fact", r"\.")[0], F.lit(" need different ids")).alias("error"))
    return reduce(DataFrame.unionByName, (second, unnamed, repeated, facts.where("error IS NOT NULL").select("scope", "file", "error"))).distinct()


def statements(facts: DataFrame, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """scope, kind, subject, name and object that facts(scope, file, fact, value) of flows state, and unresolved references; paths(path) tell which scripts exist."""
    facts = facts.where("fact IS NOT NULL").withColumn("file", F.regexp_extract("file", r"^([^.]+)", 1))
    names = facts.where("file = 'flow' AND fact = 'id'").select("scope", value_text(F.col("value")).alias("report"), F.lit(None).cast("string").alias("source"))
    facts = facts.join(names, "scope").withColumn("value", F.when(F.col("fact").rlike(rf"^{OUTCOMES}$") & (F.col("value") == "null"), '""').otherwise(F.col("value")))
    key = F.regexp_extract("fact", rf"^{NODE}action\.([^.]+)", 2)
    owner = F.create_map(*[F.lit(x) for kind, keys in ACTIONS.items() for k in keys for x in (k, kind)])[key]
    step = F.regexp_extract("fact", rf"^{NODE}action\.", 1)
    kinds = facts.where(F.col("fact").rlike(rf"^{NODE}action\.kind$")).select("scope", step.alias("step"), value_text(F.col("value")).alias("is"))
    mine = facts.withColumn("owner", F.when(F.col("file") == "flow", owner)).withColumn("step", step)
    plain = mine.where("owner IS NULL").drop("owner", "step")
    facts = cut(plain.unionByName(mine.where("owner IS NOT NULL").join(kinds.withColumnRenamed("is", "owner"), ["scope", "step", "owner"], "left_semi").drop("owner", "step")))
    texts = cut(texts_of(facts.where("file <> 'flow' OR fact NOT LIKE 'config.%'")))
    refs = references(texts)
    known = facts.where("file = 'flow' AND value NOT LIKE '{%'").select("scope", F.regexp_extract("fact", r"^config\.(.+)$", 1).alias("prefix")).where("prefix <> ''")
    refs = cut(refs.join(resolved(refs.select("scope", "name").distinct(), known), ["scope", "name"]))
    made = [applied(texts, RULES), *_of_parameters(facts, refs), *_of_steps(texts, paths), *_of_texts(texts)]
    unresolved = refs.where("prefix IS NULL").select(F.col("report").alias("flow"), "subject", "rel", "name")
    return cut(reduce(DataFrame.unionByName, made).distinct()), unresolved


def read_flows(spark: SparkSession, folder: str) -> Flows:
    """All flows below a folder; only names, no contents, are read of files that aren't flows or bindings."""
    facts = cut(read_facts(spark, folder, FILES))
    skipped = cut(left_out(facts))
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    stated, unresolved = statements(facts.join(skipped.select("scope").distinct(), "scope", "left_anti"), paths)
    return Flows(graph_of(stated), skipped, unresolved)
