"""The questions over two report folders and a small flow, written here."""

import json

import pytest

from atlasweave.operators.questions import readiness_matrix, statuses
from atlasweave.plans import question_bank as bank
from atlasweave.sources.lift import EDGES, LITERALS, NODES, Graph
from atlasweave.sources.reports import read_reports

REPORT = {
    "report": {"id": "pool-card", "version": "1.0.0", "title": "Pool card", "kind": "card", "purpose": "shows a swimming pool to visitors", "owner": "leisure", "locales": ["en", "fr"], "parameters": [{"name": "pool", "meaning": "which pool"}, {"name": "day", "meaning": "which day"}]},
    "sections": [
        {"id": "head", "title": {"en": "Head"}, "purpose": "names the pool", "component": "banner", "fields": ["pool_name", "depth"]},
        {"id": "hours", "title": {"en": "Hours"}, "purpose": "opening hours", "component": "table", "fields": ["opening"], "present_when": "open"},
    ],
    "fields": {
        "pool_name": {"type": "text", "label": {"en": "Pool", "fr": "Bassin"}, "meaning": "name of the pool", "meaning_fr": "nom du bassin", "aliases": ["bath", "basin"], "rules": ["must be shown"]},
        "depth": {"type": "number", "label": {"en": "Depth"}, "meaning": "greatest depth in metres"},
        "opening": {"type": "list", "meaning": "times at which it opens"},
    },
}
LINEAGE = {"source": {"name": "town", "kind": "sqlite"}, "table": {"dataset": "sport", "name": "pools"}, "parameters": {"pool": "pool_id"}, "queries": {"pools": {"sql": "select pool_id"}}, "fields": {"pool_name": {"status": "verified", "column": "title"}, "depth": {"status": "proposed", "column": "depth_m"}, "opening": {"status": "unmapped", "note": "asked"}}}
PROVENANCE = {
    "lifecycle": [{"status": "inception", "by": "ada", "at": "2024-01-01"}, {"status": "saved", "by": "bob", "at": "2024-02-01"}],
    "source_reports": [{"id": "old", "role": "model", "repo_url": "x/old.pdf", "sha256": "ab" * 32}],
    "runs": [{"id": "r1", "flow": "f", "flow_version": "1", "engine_version": "2", "started": "2024-01-02", "inputs": ["old"], "result": "passed", "decisions": [{"gate": "g", "decision": "yes", "reviewer": "cy", "at": "2024-01-03"}]}],
    "template": {"repo_url": "x/t", "version": "1.1.0", "frozen": True},
}
MANIFEST = {
    "engine_version": "2.0", "assets_pending": ["logo"], "schedule": {"cadence": "daily", "run_on": "on_demand", "as_of": "today", "timezone": "UTC"},
    "verify": {"golden_static_ssim_min": 0.95, "overflow_blocking": True}, "publish": {"path": "out/{template_id}"}, "parameters": {"pool": {"universe": "pools"}, "day": {"meaning": "the day"}},
    "observability": {"deliver_within_hours": 4, "max_failure_rate": 0.1, "alert": ["b@x", "a@x"], "run_log": "log"},
}
HISTORY = {"revisions": [{"revision": 1, "at": "2024-01-01", "by": "ada", "why": "first", "facts": {"x": 1}}, {"revision": 2, "at": "2024-02-01", "by": "bob", "why": "clearer", "changes": [{"fact": "report.fields.depth.meaning", "kind": "changed", "from": "depth", "to": "greatest depth in metres"}]}]}


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("reports")
    other = json.loads(json.dumps(REPORT))
    other["report"] = {"id": "lake-card", "version": "1.0.0", "title": "Lake card", "kind": "card", "purpose": "shows a lake to its visitors", "locales": ["en"]}
    other["fields"].pop("opening")
    other["sections"] = other["sections"][:1]
    for folder, files in (("pool", {"semantic/report": REPORT, "semantic/lineage": LINEAGE, "semantic/provenance": PROVENANCE, "semantic/history": HISTORY, "manifest": MANIFEST}), ("lake", {"semantic/report": other}), ("pool2", {"semantic/report": REPORT}), ("torn", {"semantic/report": None})):
        for name, content in files.items():
            path = root / folder / f"{name}.json"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(json.dumps(content) if content else "{")
    return read_reports(spark, str(root))


def rows(graph, question, *columns, param=None, what="answer"):
    found = bank.ask(graph, question, param)[what]
    return sorted(tuple(r) for r in found.select(*columns).collect())


def test_skipped_folders_are_named(catalogue):
    assert {(r.scope, r.error[:6]) for r in catalogue[1].collect()} == {("pool2", "report"), ("torn", "Expect")}


CASES = [
    ("CQ1", ("locale", "label", "definition"), "depth", {("en", "Depth", "greatest depth in metres")}),
    ("CQ2", ("section", "fields", "present_when"), "pool-card", {("head", "depth, pool_name", None), ("hours", "opening", "open")}),
    ("CQ3", ("source", "role", "engine", "flow", "gate", "reviewer", "at"), "pool-card", {("x/old.pdf", "model", "2", "f", "g", "cy", "2024-01-03")}),
    ("CQ4", ("fid", "rule"), "pool-card", {("pool_name", "must be shown")}),
    ("CQ5", ("fid", "status", "table", "column", "stored", "note"), "pool-card", {("pool_name", "verified", "pools", "title", "value", None), ("depth", "proposed", "pools", "depth_m", "value", None), ("opening", "unmapped", None, None, "json", "asked")}),
    ("CQ6", ("report", "fid", "dataset"), "title", {("pool-card", "pool_name", "sport")}),
    ("CQ7", ("source", "kind", "table", "parameter", "column"), "pool-card", {("town", "sqlite", "pools", "pool", "pool_id")}),
    ("CQ8", ("section", "component", "version", "frozen"), "opening", {("hours", "table", "1.1.0", "true")}),
    ("CQ9", ("report", "section"), "depth", {("lake-card", "head"), ("pool-card", "head")}),
    ("CQ10", ("version", "cadence", "run_on", "calendar"), "pool-card", {("1.1.0", "daily", "on_demand", None)}),
    ("CQ11", ("ssim_min", "sample_rate"), "pool-card", {("0.95", None)}),
    ("CQ12", ("parameter", "universe", "sql", "values", "path"), "pool-card", {("pool", "pools", "select pool_id", "", "out/{template_id}"), ("day", None, None, "", "out/{template_id}")}),
    ("CQ13", ("engine", "ontology", "asset_pending"), "pool-card", {("2.0", None, "logo")}),
    ("CQ14", ("report", "status", "cadence", "owner"), None, {("pool-card", "saved", "daily", "leisure"), ("lake-card", None, None, None)}),
    ("CQ15", ("param", "other", "shared", "fields"), None, {("pool-card", "lake-card", 2, "depth, pool_name"), ("lake-card", "pool-card", 2, "depth, pool_name")}),
    ("CQ16", ("report", "section"), "banner", {("pool-card", "head"), ("lake-card", "head")}),
    ("CQ17", ("deliver_within", "alerts"), "pool-card", {("4", "a@x|b@x")}),
    ("CQ18", ("fid", "reports", "label", "aliases"), None, {("pool_name", 2, "Pool", "basin|bath"), ("depth", 2, "Depth", None), ("opening", 1, None, None)}),
    ("CQ19", ("step", "status", "by", "current"), "pool-card", {(1, "inception", "ada", None), (2, "saved", "bob", "yes")}),
    ("CQ20", ("revision", "reason", "fact", "old"), "pool-card", {(1, "first", None, None), (2, "clearer", "report.fields.depth.meaning", "depth")}),
    ("CQ21", ("report", "revision", "kind"), "depth", {("pool-card", 2, "changed")}),
]


@pytest.mark.parametrize("question, columns, param, want", CASES, ids=[c[0] for c in CASES])
def test_answers(catalogue, question, columns, param, want):
    assert set(rows(catalogue[0], question, *columns, param=param)) == want


GAPS = [
    ("CQ1", ("param", "locale"), {("depth", "fr"), ("opening", "fr")}), ("CQ3", ("param",), {("lake-card",)}), ("CQ5", ("param", "fid"), {("pool-card", "opening")}), ("CQ7", ("param",), {("lake-card",)}), ("CQ10", ("param",), set()), ("CQ11", ("why",), {("no approval policy",)}),
    ("CQ12", ("parameter",), {("day",)}), ("CQ13", ("why",), {("frozen without an ontology version",), ("asset is pending: logo",)}), ("CQ14", ("report",), {("lake-card",)}), ("CQ17", ("param",), set()), ("CQ19", ("param",), {("lake-card",)}), ("CQ20", ("param",), {("lake-card",)}), ("CQ21", ("param", "report"), {("pool_name", "lake-card"), ("depth", "lake-card")}),
]


@pytest.mark.parametrize("question, columns, want", GAPS, ids=[c[0] for c in GAPS])
def test_gaps(catalogue, question, columns, want):
    assert set(rows(catalogue[0], question, *columns, what="gaps")) == want


def test_unknown_question_names_the_known(catalogue):
    with pytest.raises(KeyError, match="CQ21"):
        bank.ask(catalogue[0], "CQ99")


@pytest.fixture(scope="module")
def flow(spark):
    nodes = [("s1", "DeterministicStep", "read"), ("s2", "HumanStep", "review"), ("end", "TerminalStep", "end"), ("a1", "Artifact", "a1"), ("a2", "Artifact", "a2")]
    edges = [
        ("s1", "writes", "a1"), ("s2", "reads", "a1"), ("s2", "readsOptional", "a2"), ("s1", "hasCheck", "k"), ("k", "measures", "m"), ("k", "comparedTo", "p"), ("k", "onFail", "o2"), ("s1", "hasOutcome", "o1"), ("s1", "hasOutcome", "o2"),
        ("t", "from", "s1"), ("t", "onOutcome", "o1"), ("t", "to", "s2"), ("t", "usesParameter", "q"), ("i", "enforcedBy", "k"), ("a1", "carries", "c"), ("s1", "usesParameter", "q"),
    ]
    literals = [
        ("s1", "stepId", "S1"), ("s1", "label", "Read"), ("s1", "description", "reads"), ("s1", "command", "run.py"), ("s1", "isImplemented", "false"), ("s2", "stepId", "S2"), ("s2", "label", "Review"), ("s2", "description", "looks"), ("s2", "decisionOption", "yes"), ("s2", "decisionOption", "no"), ("s2", "requiredField", "who"),
        ("a1", "path", "a.json"), ("a1", "format", "json"), ("a2", "path", "b.txt"), ("a2", "format", "text"), ("k", "checkId", "K"), ("k", "checkKind", "metric"), ("k", "expression", "m > p"), ("k", "blocking", "true"), ("m", "metricName", "M"), ("p", "paramName", "P"), ("p", "value", "3"), ("q", "paramName", "Q"),
        ("o1", "outcomeName", "ok"), ("o2", "outcomeName", "bad"), ("t", "guard", "x > 1"), ("t", "readsStatePath", "x"), ("i", "statement", "sums agree"), ("c", "label", "Concept"), ("c", "definition", "a thing"),
    ]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(literals, LITERALS))


FLOW = [
    ("FL01", ("param", "type"), {("s1", "DeterministicStep"), ("s2", "HumanStep")}), ("FL02", ("param", "direction", "path"), {("s1", "output", "a.json"), ("s2", "input", "a.json"), ("s2", "input (optional)", "b.txt")}), ("FL03", ("param",), set()),
    ("FL04", ("param", "check", "on_fail", "metric", "parameter"), {("s1", "K", "bad", "M", "P")}), ("FL06", ("param", "parameter", "via"), {("s1", "P", "check")}), ("FL07", ("param", "statement"), {("s1", "sums agree")}), ("FL08", ("param", "mode"), {("s1", "command")}), ("FL09", ("param", "consumer"), {("s1", "S2")}),
    ("FL10", ("param", "artifact", "definition"), {("s1", "a1", "a thing"), ("s2", "a1", "a thing")}), ("FL11", ("param", "outcome", "guard", "to"), {("s1", "ok", "x > 1", "S2")}), ("FL12", ("param", "kind"), {("s1", "pass_case"), ("s1", "fail_case"), ("s1", "route"), ("s1", "property")}), ("FL13", ("t", "state_path"), {("t", "x")}),
    ("FL14", ("step", "option", "required_field"), {("S2", "yes", "who"), ("S2", "no", "who")}), ("FL15", ("step", "implemented"), {("S1", "false")}), ("FL16", ("param", "kind", "step"), {("p", "check", "S1"), ("q", "transition", "S1"), ("q", "step action", "S1"), ("p", "test", "S1")}), ("FL17", ("param", "role", "step"), {("a1", "writer", "S1"), ("a1", "reader", "S2"), ("a2", "reader (optional)", "S2")}),
]


@pytest.mark.parametrize("question, columns, want", FLOW, ids=[c[0] for c in FLOW])
def test_flow_answers(flow, question, columns, want):
    assert set(rows(flow, question, *columns)) == want


def test_flow_gaps_and_readiness(spark, flow):
    assert rows(flow, "FL03", "param", "artifact", what="gaps") == [("s1", "a1")]
    assert rows(flow, "FL05", "param", "metric", what="gaps") == [("s1", "M")]
    assert rows(flow, "FL06", "param", "parameter", what="gaps") == [("s1", "Q")]
    assert rows(flow, "FL08", "param", what="gaps") == [("s2",)]
    assert rows(flow, "FL10", "param", "artifact", what="gaps") == [("s2", "a2")]
    assert rows(flow, "FL11", "param", "outcome", what="gaps") == [("s1", "bad")]
    asked = [q for q in bank.FLOW_QUESTIONS if q.id in ("FL04", "FL11", "FL12")]
    found = statuses(asked, flow, spark.createDataFrame([("s1",), ("s2",)], "param string"))
    matrix = {r.param: r["write-tests"] for r in readiness_matrix(found, [b for b in bank.FLOW_BRIEFS if b.task == "write-tests"]).collect()}
    assert matrix == {"s1": "BLOCKED", "s2": "BLOCKED"}


def test_derived_tests_open_only_what_is_asked_for(spark, flow, tmp_path):
    """Test obligations are derived once, however many parts of them a question reads, and no table of keys goes through the driver."""
    opened = []

    def part(table, name):
        def make():
            opened.append(name)
            return {"nodes": flow.nodes_of, "edges": flow.edges_of, "literals": flow.literals_of}[table]([name])

        return make

    names = {"nodes": ["HumanStep", "DeterministicStep"], "edges": ["hasCheck", "from", "onOutcome", "to", "enforcedBy", "writes", "reads"], "literals": ["checkId", "outcomeName", "guard", "toDynamic", "stepId", "statement", "path", "format"]}
    graph = Graph(parts={t: {n: part(t, n) for n in ns} for t, ns in names.items()}, spark=spark)
    found = bank.fl12(graph)
    assert sorted(opened) == sorted(["hasCheck", "checkId", "from", "onOutcome", "outcomeName", "guard", "toDynamic", "to", "stepId", "enforcedBy", "hasCheck", "stepId", "statement"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, bank.fl12(flow).collect())) != []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") >= 3 and "Broadcast" not in plan


def test_a_graph_with_more_rows_answers_as_one_table(spark, flow):
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    more = flow.with_more(nodes={"Test": spark.createDataFrame([("x", "Test", "x")], NODES)}, edges={"reads": spark.createDataFrame([("x", "reads", "a1")], EDGES)})
    more = more.with_more(edges={"reads": spark.createDataFrame([("y", "reads", "a1")], EDGES)})
    assert [r.id for r in more.nodes_of(["Test"]).collect()] == ["x"] and flow.nodes_of(["Test"]).isEmpty() and flow.edges_of(["reads"]).count() == 1
    assert rows(more.edges_of(["reads", "writes"])) == rows(more.edges.where("rel IN ('reads', 'writes')")) and more.edges.count() == flow.edges.count() + 2
    assert rows(more.nodes) == rows(more.nodes_of([r.type for r in more.nodes.select("type").distinct().collect()])) and rows(more.literals) == rows(flow.literals)
    other = more.with_edges(spark.createDataFrame([("a", "b", "c")], EDGES))
    assert rows(other.edges) == [("c", "b", "a")] and rows(other.nodes) == rows(more.nodes)
    assert {r.value for r in more.statements_of("Test", ["reads"]).where("focus = 'x'").collect()} == {None, "a1"}


def joined_rows(df) -> int:
    """The most rows that a join of df's plan gives."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        kind, children = p.getClass().getSimpleName(), p.children()
        todo += [children.apply(i) for i in range(children.size())]
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif "Join" in kind:
            most = max(most, p.metrics().apply("numOutputRows").value())
    return most


def test_reports_are_paired_by_ids_not_by_fields(spark):
    ids = spark.range(2000)
    edges = ids.selectExpr("concat('f', id) AS src", "'inReport' AS rel", "concat('r', id % 4) AS dst")
    values = ids.selectExpr("concat('f', id) AS subj", "'fieldId' AS pred", "concat('x', id % 5) AS value").unionByName(spark.createDataFrame([(f"r{k}", "reportId", f"R{min(k, 2)}") for k in range(4)], LITERALS))
    found = bank.cq15(Graph(spark.createDataFrame([], NODES), edges, values))
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"R{a}", f"R{b}", 5, "x0, x1, x2, x3, x4") for a in range(3) for b in range(3) if a != b or a == 2)
    assert joined_rows(found) <= 2000
