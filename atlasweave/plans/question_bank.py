"""The questions over report definitions and flows: each an answer and, where an empty answer could mislead, its gaps.

All are evaluated for every parameter value at once; `param` is the report, field, column, component, step, parameter or
artifact that a question is about (`all` for those without one), and filters on it reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..functions.text import after, joined
from ..operators.patterns import Edge, Either, Maybe, Node, NotEdge, Value, Where, match
from ..operators.questions import Brief, Question
from ..sources.lift import Graph

STRUCTURED = ("list", "grouped_list", "series", "list_of_text", "currency_pair", "percent_by_series")


def has(var: str, **names: str) -> tuple:
    """Values of a variable's properties, all required; has("f", fid="fieldId")."""
    return tuple(Value(var, pred, as_) for as_, pred in names.items())


def may(var: str, **names: str) -> tuple:
    """The same, each optional on its own."""
    return tuple(Maybe((Value(var, pred, as_),)) for as_, pred in names.items())


def _why(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("why", F.lit(text))


def _lacks(g: Graph, clauses: list, var: str, *, edges: tuple = (), values: tuple = ()) -> DataFrame:
    """Solutions whose variable has none of the edges and values."""
    rows = match(g, [*clauses, *(NotEdge(var, e, "*") for e in edges)])
    for v in values:
        rows = rows.join(g.literals_of([v]).select(F.col("subj").alias(var)), var, "left_anti")
    return rows


REPORT = has("r", param="reportId")
RELEASE = (*REPORT, Edge("r", "releasedAs", "rel"), *has("rel", version="version"))
FIELD = has("f", param="fieldId")


def cq1(g: Graph) -> DataFrame:
    return match(g, [*FIELD, Edge("f", "hasMeaning", "m"), *has("m", locale="locale", definition="definition"), *may("m", label="label")]).select("param", "f", "locale", "label", "definition")


def cq1_gaps(g: Graph) -> DataFrame:
    offered = match(g, [*FIELD, Edge("f", "inReport", "r"), *has("r", locale="locale")])
    explained = match(g, [Edge("f", "hasMeaning", "m"), *has("m", locale="locale")]).select("f", "locale")
    return _why(offered.join(explained, ["f", "locale"], "left_anti").select("param", "f", "locale"), "no meaning in a locale of the report")


def cq2(g: Graph) -> DataFrame:
    rows = match(g, [*REPORT, Edge("r", "hasSection", "s"), *has("s", purpose="purpose"), Edge("s", "hasField", "f"), *has("f", fid="fieldId"), *may("s", present_when="presentWhen")])
    return rows.groupBy("param", after(F.col("s"), "section/").alias("section"), "purpose", "present_when").agg(joined(F.col("fid")).alias("fields"))


def cq3(g: Graph) -> DataFrame:
    approval = Maybe((Edge("run", "hasApproval", "a"), *has("a", gate="gate", decision="decision", reviewer="reviewer"), *may("a", at="at")))
    source = (Edge("r", "derivedFrom", "src"), *has("src", source="repoUrl", sha256="sha256"), *may("src", role="role", reference_kind="referenceKind"))
    return match(g, [*REPORT, *source, Edge("run", "usedSource", "src"), *has("run", flow_version="flowVersion", engine="engineVersion", result="result"), *may("run", flow="flow", started="startedAt"), approval])


def cq4(g: Graph) -> DataFrame:
    rule = (*REPORT, Edge("f", "inReport", "r"), *has("f", fid="fieldId"), Edge("f", "hasRule", "ru"), *has("ru", rule="ruleText"), *may("ru", regulatory="regulatory"))
    return match(g, list(rule)).select("param", "fid", "rule", "regulatory")


def cq5(g: Graph) -> DataFrame:
    column = Maybe((Edge("f", "sourcedFrom", "c"), *has("c", column="columnName"), Edge("c", "inTable", "t"), *has("t", dataset="dataset", table="tableName")))
    rows = match(g, [*REPORT, Edge("f", "inReport", "r"), *has("f", fid="fieldId", status="lineageStatus", type="fieldType"), column, *may("f", note="lineageNote")])
    return rows.withColumn("stored", F.when(F.col("type").isin(*STRUCTURED), "json").otherwise("value")).select("param", "fid", "status", "dataset", "table", "column", "type", "stored", "note")


def cq6(g: Graph) -> DataFrame:
    return match(g, [*has("c", param="columnName"), Edge("c", "inTable", "t"), *has("t", dataset="dataset", table="tableName"), Edge("f", "sourcedFrom", "c"), *has("f", fid="fieldId", status="lineageStatus"), Edge("f", "inReport", "r"), *has("r", report="reportId")])


def cq7(g: Graph) -> DataFrame:
    source = Maybe((Edge("t", "inDataSource", "s"), *has("s", source="label"), *may("s", kind="sourceKind", database="database")))
    bound = Maybe((Edge("r", "hasParameter", "p"), *has("p", parameter="label"), Edge("p", "boundToColumn", "c"), *has("c", column="columnName")))
    return match(g, [*REPORT, Edge("r", "readsTable", "t"), *has("t", dataset="dataset", table="tableName"), source, bound])


def cq7_gaps(g: Graph) -> DataFrame:
    none = _why(match(g, [*REPORT, NotEdge("r", "readsTable", "*")]).select("param"), "no table is named")
    return none.unionByName(_why(match(g, [*REPORT, Edge("r", "readsTable", "t"), NotEdge("t", "inDataSource", "*")]).select("param"), "the table has no data source"))


def cq8(g: Graph) -> DataFrame:
    release = Maybe((Edge("r", "releasedAs", "rel"), *has("rel", version="version"), *may("rel", frozen="frozen")))
    rows = match(g, [*FIELD, Edge("f", "inSection", "s"), Edge("f", "inReport", "r"), Edge("s", "renderedBy", "c"), release])
    return rows.select("param", after(F.col("s"), "section/").alias("section"), after(F.col("c"), "component/").alias("component"), "rel", "version", "frozen")


def cq9(g: Graph) -> DataFrame:
    rows = match(g, [*FIELD, Edge("f", "inReport", "r"), Edge("f", "inSection", "s"), *has("r", report="reportId")])
    return rows.select("param", "report", after(F.col("s"), "section/").alias("section"))


def cq10(g: Graph) -> DataFrame:
    return match(g, [*RELEASE, Edge("rel", "hasSchedule", "s"), *has("s", cadence="cadence", run_on="runOn", as_of="asOfRule", timezone="timezone"), *may("s", calendar="calendar"), *may("rel", frozen="frozen")])


def cq11(g: Graph) -> DataFrame:
    verify = Maybe((Edge("rel", "hasVerificationPolicy", "v"), *has("v", ssim_min="goldenStaticSsimMin", overflow_blocking="overflowBlocking"), *may("v", fidelity_min="fidelityMin")))
    approve = Maybe((Edge("rel", "hasApprovalPolicy", "a"), *has("a", sample_rate="sampleRate", sample_min="sampleMin"), *may("a", full_review="fullReviewAfterRelease", reviewer_role="reviewerRole")))
    return match(g, [*RELEASE, verify, approve])


def cq11_gaps(g: Graph) -> DataFrame:
    lack = lambda rel, text: _why(match(g, [*RELEASE, NotEdge("rel", rel, "*")]).select("param", "version"), text)
    return lack("hasVerificationPolicy", "no verification policy").unionByName(lack("hasApprovalPolicy", "no approval policy"))


PARAMETER = (*REPORT, Edge("r", "releasedAs", "rel"), Edge("rel", "hasParameter", "p"), *has("p", parameter="label"))


def cq12(g: Graph) -> DataFrame:
    universe = Maybe((Edge("p", "universeQuery", "u"), *has("u", universe="label"), *may("u", sql="sql")))
    publish = Maybe((Edge("rel", "hasPublishPolicy", "pub"), *has("pub", path="pathPattern"), *may("pub", format="publishFormat", retention="retentionDays")))
    rows = match(g, [*PARAMETER, *may("p", definition="definition", value="allowedValue", bound_by="boundBy"), universe, publish])
    return rows.groupBy("param", "parameter", "definition", "universe", "sql", "bound_by", "path", "format", "retention").agg(joined(F.col("value"), "|").alias("values"))


def cq12_gaps(g: Graph) -> DataFrame:
    return _why(_lacks(g, list(PARAMETER), "p", edges=("universeQuery",), values=("allowedValue", "boundBy")).select("param", "parameter"), "nothing says which values the parameter takes")


def cq13(g: Graph) -> DataFrame:
    return match(g, [*RELEASE, *may("rel", engine="engineVersion", ontology="ontologyVersion", library="libraryVersion", font="font", file="fileHash", asset_pending="assetPending", waiver="waiver")])


def cq13_gaps(g: Graph) -> DataFrame:
    frozen = [*RELEASE, *has("rel", frozen="frozen"), Where(F.col("frozen") == "true")]
    lack = lambda pred, text: _why(_lacks(g, frozen, "rel", values=(pred,)).select("param", "version"), text)
    pending = match(g, [*frozen, *has("rel", asset="assetPending")]).select("param", "version", F.concat(F.lit("asset is pending: "), "asset").alias("why"))
    return lack("engineVersion", "frozen without an engine version").unionByName(lack("ontologyVersion", "frozen without an ontology version")).unionByName(pending)


def cq14(g: Graph) -> DataFrame:
    schedule = Maybe((Edge("rel", "hasSchedule", "s"), *has("s", scheduled="cadence")))
    release = Maybe((Edge("r", "releasedAs", "rel"), *has("rel", version="version"), *may("rel", frozen="frozen"), schedule))
    rows = match(g, [Node("r", "ReportType"), *has("r", report="reportId", title="label", kind="kind", purpose="purpose"), *may("r", declared="cadence", owner="owner"), release])
    status = cq19(g).where("current = 'yes'").select(F.col("param").alias("report"), "status")
    return rows.join(status, "report", "left").select(F.lit("all").alias("param"), "report", "title", "status", "kind", F.coalesce("scheduled", "declared").alias("cadence"), "owner", "version", "frozen", "purpose")


def cq14_gaps(g: Graph) -> DataFrame:
    return _why(_lacks(g, [Node("r", "ReportType"), *has("r", report="reportId")], "r", values=("owner",)).select(F.lit("all").alias("param"), "report"), "no owner is named")


def cq15(g: Graph) -> DataFrame:
    """Each id counts once in a report before reports are paired, however many fields have it there."""
    mine = match(g, [*REPORT, Edge("f", "inReport", "r"), *has("f", fid="fieldId")]).select("param", "r", "fid").distinct()
    theirs = mine.toDF("other", "o", "fid")
    return mine.join(theirs, "fid").where("o <> r").groupBy("param", "other").agg(F.countDistinct("fid").alias("shared"), joined(F.col("fid")).alias("fields"))


def cq16(g: Graph) -> DataFrame:
    rows = match(g, [Node("c", "Component"), *has("c", param="label"), Edge("s", "renderedBy", "c"), Edge("r", "hasSection", "s"), *has("r", report="reportId")])
    return rows.select("param", "report", after(F.col("s"), "section/").alias("section"))


def cq17(g: Graph) -> DataFrame:
    rows = match(g, [*RELEASE, Edge("rel", "hasObservabilityPolicy", "o"), *has("o", deliver_within="deliverWithinHours", failure_rate="maxFailureRate", run_log="runLog"), *may("o", alert="alertRecipient")])
    return rows.groupBy("param", "version", "deliver_within", "failure_rate", "run_log").agg(joined(F.col("alert"), "|").alias("alerts"))


def cq18(g: Graph) -> DataFrame:
    aliases = match(g, has("a", fid="fieldId", alias="alias")).groupBy("fid").agg(joined(F.col("alias"), "|").alias("aliases"))
    rows = match(g, [*has("f", fid="fieldId", type="fieldType"), Edge("f", "inReport", "r"), Edge("f", "hasMeaning", "m"), *has("m", locale="locale", definition="definition"), Where(F.col("locale") == "en"), *may("m", label="label")])
    counted = rows.groupBy("fid", "type").agg(F.countDistinct("r").alias("reports"), F.min("label").alias("label"), F.min("definition").alias("definition"))
    return counted.join(aliases, "fid", "left").withColumn("param", F.lit("all"))


def cq19(g: Graph) -> DataFrame:
    rows = match(g, [*REPORT, Edge("r", "hasStatusChange", "c"), *has("c", step="order", status="lifecycleStatus", by="changedBy", at="at"), *may("c", note="note")]).withColumn("step", F.col("step").cast("int") + 1)
    last = rows.groupBy("r").agg(F.max("step").alias("last"))
    return rows.join(last, "r").select("param", "step", "status", "by", "at", "note", F.when(F.col("step") == F.col("last"), "yes").alias("current"))


REVISED = (Edge("r", "hasRevision", "v"), *has("v", revision="order", by="changedBy", at="at", reason="reason"), *may("v", effective="effectiveFrom"))
CHANGED = (Edge("v", "hasChange", "c"), *has("c", fact="fact", kind="changeKind"), *may("c", old="previousValue", new="newValue"))


def cq20(g: Graph) -> DataFrame:
    return match(g, [*REPORT, *REVISED, Maybe(CHANGED)]).select("param", F.col("revision").cast("int").alias("revision"), "at", "by", "effective", "reason", "fact", "kind", "old", "new")


def cq21(g: Graph) -> DataFrame:
    """The field is the step after `fields.` in a fact's path, so the join on it stays an equi-join."""
    rows = match(g, [*has("r", report="reportId"), *REVISED, *CHANGED]).withColumn("param", F.regexp_extract("fact", r"(?:^|\.)fields\.([^.]+)(?:\.|$)", 1))
    known = match(g, FIELD).select("param").distinct()
    return rows.join(known, "param", "left_semi").select("param", "report", F.col("revision").cast("int").alias("revision"), "at", "effective", "by", "reason", "fact", "kind", "old", "new")


def cq21_gaps(g: Graph) -> DataFrame:
    return _why(match(g, [*FIELD, Edge("f", "inReport", "r"), *has("r", report="reportId"), NotEdge("r", "hasRevision", "*")]).select("param", "report"), "no accepted history")


def lacking(rel: str, text: str, clauses: tuple = REPORT, var: str = "r", keep: tuple[str, ...] = ("param",)):
    """Gaps: what has no edge of a relation."""
    return lambda g: _why(match(g, [*clauses, NotEdge(var, rel, "*")]).select(*keep), text)


REPORT_QUESTIONS = [
    Question("CQ1", cq1, cq1_gaps),
    Question("CQ2", cq2),
    Question("CQ3", cq3, lacking("derivedFrom", "no source document")),
    Question("CQ4", cq4),
    Question("CQ5", cq5, lambda g: _why(cq5(g).where("status = 'unmapped'").select("param", "fid"), "no column supplies the field")),
    Question("CQ6", cq6),
    Question("CQ7", cq7, cq7_gaps),
    Question("CQ8", cq8),
    Question("CQ9", cq9),
    Question("CQ10", cq10, lacking("hasSchedule", "no schedule", RELEASE, "rel", ("param", "version"))),
    Question("CQ11", cq11, cq11_gaps),
    Question("CQ12", cq12, cq12_gaps),
    Question("CQ13", cq13, cq13_gaps),
    Question("CQ14", cq14, cq14_gaps),
    Question("CQ15", cq15),
    Question("CQ16", cq16),
    Question("CQ17", cq17, lacking("hasObservabilityPolicy", "no observability policy", RELEASE, "rel", ("param", "version"))),
    Question("CQ18", cq18),
    Question("CQ19", cq19, lacking("hasStatusChange", "no lifecycle is recorded")),
    Question("CQ20", cq20, lacking("hasRevision", "no revision is accepted")),
    Question("CQ21", cq21, cq21_gaps),
]

# -- flows: steps, checks, transitions, artifacts, parameters ---------------------------------------------------------

STEPS = {"Step": ["DeterministicStep", "OcrStep", "ClaudeStep", "HumanStep", "TerminalStep"]}
TOUCHES = Either("direction", {"input": (Edge("param", "reads", "artifact"),), "input (optional)": (Edge("param", "readsOptional", "artifact"),), "output": (Edge("param", "writes", "artifact"),)})


def _flow(*clauses, dedup: bool = False):
    return lambda g: match(g, clauses, dedup, STEPS)


def fl01(g: Graph) -> DataFrame:
    rows = match(g, [Node("param", "Step"), *has("param", step_id="stepId", name="label", description="description"), *may("param", uses_ocr="usesOcr", foreach="foreach")], subclasses=STEPS)
    return rows.join(g.nodes_of(sorted(STEPS["Step"])).select(F.col("id").alias("param"), "type"), "param")


def fl05_gaps(g: Graph) -> DataFrame:
    checked = match(g, [Edge("param", "hasCheck", "c"), Edge("c", "measures", "m"), *has("m", metric="metricName")])
    return _why(checked.join(match(g, [Edge("param", "records", "m")]), ["param", "m"], "left_anti").select("param", "metric").distinct(), "a check reads the metric, but the step doesn't record it")


USES = Either("via", {"check": (Edge("param", "hasCheck", "c"), Edge("c", "comparedTo", "p")), "transition guard": (Edge("t", "from", "param"), Edge("t", "usesParameter", "p")), "command/action": (Node("param", "Step"), Edge("param", "usesParameter", "p"))})


def fl06(g: Graph) -> DataFrame:
    return match(g, [USES, *has("p", parameter="paramName", value="value")], subclasses=STEPS).select("param", "parameter", "value", "via").distinct()


def fl06_gaps(g: Graph) -> DataFrame:
    rows = match(g, [USES, *has("p", parameter="paramName")], subclasses=STEPS)
    rows = rows.where("via <> 'transition guard'").join(g.literals_of(["value"]).select(F.col("subj").alias("p")), "p", "left_anti")
    return _why(rows.select("param", "parameter").distinct(), "the parameter has no value")


def fl08(g: Graph) -> DataFrame:
    mode = Either("mode", {"command": has("param", spec="command"), "prompt": has("param", spec="promptRef"), "review page": has("param", spec="reviewPage")})
    return match(g, [mode, Maybe((Edge("param", "implementedBy", "i"), *has("i", path="path", exists="exists")))])


def fl08_gaps(g: Graph) -> DataFrame:
    steps = match(g, [Node("param", "DeterministicStep|OcrStep|ClaudeStep|HumanStep")])
    for pred in ("command", "promptRef", "reviewPage"):
        steps = steps.join(g.literals_of([pred]).select(F.col("subj").alias("param")), "param", "left_anti")
    return _why(steps, "no command, prompt or review page")


def fl10_gaps(g: Graph) -> DataFrame:
    return _why(match(g, [TOUCHES, NotEdge("artifact", "carries", "*")]).select("param", "artifact").distinct(), "no concept says what the artifact holds")


def fl11(g: Graph) -> DataFrame:
    target = (*may("t", priority="priority", guard="guard", dynamic="toDynamic"), Maybe((Edge("t", "to", "next"), *has("next", to_id="stepId"))))
    rows = match(g, [Edge("param", "hasOutcome", "o"), *has("o", outcome="outcomeName"), Edge("t", "from", "param"), Edge("t", "onOutcome", "o"), *target])
    return rows.withColumn("to", F.coalesce("to_id", "dynamic"))


def fl12(g: Graph) -> DataFrame:
    return match(derive_tests(g), [Node("test", "TestObligation"), Edge("test", "forStep", "param"), *has("test", kind="obligationKind", description="description")], by="merge")


def fl15(g: Graph) -> DataFrame:
    return _all(match(g, [Node("s", "DeterministicStep|OcrStep|ClaudeStep"), *has("s", step="stepId", implemented="isImplemented")]))


def _all(rows: DataFrame) -> DataFrame:
    return rows.withColumn("param", F.lit("all"))


IMPACT = Either(
    "kind",
    {
        "check": (Edge("element", "comparedTo", "param"), Edge("s", "hasCheck", "element")),
        "transition": (Edge("element", "usesParameter", "param"), Edge("element", "from", "s")),
        "step action": (Edge("s", "usesParameter", "param"), Node("s", "Step")),
        "test": (Edge("c", "comparedTo", "param"), Edge("element", "tests", "c"), Edge("element", "forStep", "s")),
    },
)


def derive_tests(g: Graph) -> Graph:
    """The graph with test obligations: pass and fail cases of checks, routes of transitions, and a property for each invariant and enforcing step."""
    cases = match(g, [Edge("s", "hasCheck", "c"), *has("c", name="checkId")], by="merge")
    case = F.explode(F.array(*[F.struct(F.concat("c", F.lit(f"/test/{k}")).alias("id"), F.lit(f"{k}_case").alias("kind"), F.concat(F.lit(f"input that the check {verb}: "), "name").alias("text")) for k, verb in (("pass", "accepts"), ("fail", "refuses"))]))
    tests = cases.select("s", F.col("c").alias("subject"), case.alias("x")).select("x.*", "s", "subject")
    routes = match(g, [Edge("t", "from", "s"), Edge("t", "onOutcome", "o"), *has("o", outcome="outcomeName"), *may("t", guard="guard", dynamic="toDynamic"), Maybe((Edge("t", "to", "next"), *has("next", to_id="stepId")))], by="merge")
    text = F.concat(F.lit("on "), "outcome", F.when(F.col("guard").isNotNull(), F.concat(F.lit(" if "), "guard")).otherwise(F.lit("")), F.lit(" go to "), F.coalesce("to_id", "dynamic", F.lit("?")))
    tests = tests.unionByName(routes.select(F.concat("t", F.lit("/test/route")).alias("id"), F.lit("route").alias("kind"), text.alias("text"), "s", F.col("t").alias("subject")))
    kept = match(g, [Edge("i", "enforcedBy", "c"), Edge("s", "hasCheck", "c"), *has("s", step_id="stepId")], by="merge")
    kept = match(g, has("i", statement="statement"), bound=kept)  # few invariants with many checks each
    tests = tests.unionByName(kept.select(F.concat("i", F.lit("/test/"), "step_id").alias("id"), F.lit("property").alias("kind"), F.col("statement").alias("text"), "s", F.col("i").alias("subject"))).distinct()
    tests = written(tests, "tests")  # derived once for all parts that a question reads
    part = lambda tag, name, *columns: tests.select(*columns, F.lit(name).alias(tag)).distinct()
    return g.with_more(
        nodes={"TestObligation": part("type", "TestObligation", "id", F.col("id").alias("label"))},
        edges={name: part("rel", name, F.col("id").alias("src"), F.col(column).alias("dst")) for name, column in (("forStep", "s"), ("tests", "subject"))},
        literals={name: part("pred", name, F.col("id").alias("subj"), F.col(column).alias("value")) for name, column in (("obligationKind", "kind"), ("description", "text"))},
    )


FLOW_QUESTIONS = [
    Question("FL01", fl01),
    Question("FL02", _flow(TOUCHES, *has("artifact", path="path", format="format"))),
    Question("FL03", _flow(Edge("param", "writes", "artifact"), Edge("artifact", "hasField", "f"), *has("f", path="fieldPath")), lambda g: _why(match(g, [Edge("param", "writes", "artifact"), *has("artifact", format="format"), Where(F.col("format").isin("json", "json-schema")), NotEdge("artifact", "hasField", "*")]), "JSON without a list of fields"), "gaps_only"),
    Question(
        "FL04",
        _flow(Edge("param", "hasCheck", "c"), *has("c", check="checkId", kind="checkKind", expression="expression", blocking="blocking"), Edge("c", "onFail", "o"), *has("o", on_fail="outcomeName"), Maybe((Edge("c", "measures", "m"), *has("m", metric="metricName"))), Maybe((Edge("c", "comparedTo", "p"), *has("p", parameter="paramName", value="value")))),
        lambda g: _why(match(g, [Edge("param", "hasCheck", "c"), *has("c", kind="checkKind"), Where(F.col("kind") == "metric"), NotEdge("c", "measures", "*")]), "a metric check without a metric"),
        "gaps_only",
    ),
    Question("FL05", _flow(Edge("param", "records", "m"), *has("m", metric="metricName")), fl05_gaps, "gaps_only"),
    Question("FL06", fl06, fl06_gaps, "gaps_only"),
    Question("FL07", _flow(Edge("param", "hasCheck", "c"), Edge("i", "enforcedBy", "c"), *has("i", statement="statement"))),
    Question("FL08", fl08, fl08_gaps, "gaps_only"),
    Question("FL09", lambda g: match(g, [Edge("param", "writes", "artifact"), Edge("c", "reads|readsOptional", "artifact"), *has("c", consumer="stepId"), Where(F.col("c") != F.col("param"))])),
    Question("FL10", lambda g: match(g, [TOUCHES, Edge("artifact", "carries", "concept"), *has("concept", label="label", definition="definition")]).drop("direction").distinct(), fl10_gaps, "gaps_only"),
    Question("FL11", fl11, lambda g: _why(match(g, [Edge("param", "hasOutcome", "o"), *has("o", outcome="outcomeName"), NotEdge("*", "onOutcome", "o")]), "no transition for the outcome"), "gaps_only"),
    Question("FL12", fl12),
    Question("FL13", lambda g: _all(match(g, has("t", guard="guard", state_path="readsStatePath")))),
    Question("FL14", lambda g: _all(match(g, [Node("s", "HumanStep"), *has("s", step="stepId", option="decisionOption", required_field="requiredField")]))),
    Question("FL15", fl15, lambda g: _all(_why(match(g, [*has("s", step="stepId", done="isImplemented"), Where(F.col("done") == "true"), Edge("s", "implementedBy", "i"), *has("i", exists="exists"), Where(F.col("exists") == "false")]), "marked as done, but the script is missing")), "gaps_only"),
    Question("FL16", lambda g: match(derive_tests(g), [IMPACT, *has("s", step="stepId")], subclasses=STEPS)),
    Question("FL17", _flow(Either("role", {"writer": (Edge("s", "writes", "param"),), "reader": (Edge("s", "reads", "param"),), "reader (optional)": (Edge("s", "readsOptional", "param"),)}), *has("s", step="stepId"))),
]

FLOW_BRIEFS = [
    Brief("implement-step", ("FL01", "FL02", "FL03", "FL04", "FL05", "FL06", "FL08", "FL10", "FL11"), ("FL07", "FL09")),
    Brief("write-tests", ("FL04", "FL11", "FL12"), ("FL07", "FL03")),
    Brief("build-engine", ("FL13", "FL14", "FL15")),
    Brief("impact-parameter", ("FL16",)),
    Brief("impact-artifact", ("FL17",)),
]


#: The properties whose values a question's parameter may be, beside the ids of nodes.
NAMES = ("reportId", "fieldId", "columnName", "label")


def ask(graph: Graph, question: str, param: str | None = None) -> dict[str, DataFrame]:
    """The answer and gap rows of a question, for one parameter value or for all.

    An unknown question is an error that lists the known ones; a parameter value that is neither a node's id nor a name in the graph is one too, as
    its empty answer would look complete.
    """
    known = {q.id: q for q in (*REPORT_QUESTIONS, *FLOW_QUESTIONS)}
    if question not in known:
        raise KeyError(f"no question {question}; there are {', '.join(known)}")
    if param is not None and param != "all":
        named = graph.literals_of(list(NAMES)).where(F.col("value") == param)
        if graph.nodes.where(F.col("id") == param).isEmpty() and named.isEmpty():
            raise KeyError(f"{question}: nothing in the graph is named {param}")
    chosen = lambda rows: rows if rows is None or param is None else rows.where(F.col("param") == param)
    q = known[question]
    return {"answer": chosen(q.answer(graph)), "gaps": chosen(q.gaps(graph) if q.gaps else None)}
