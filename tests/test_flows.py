"""Flow folders as a graph that answers the flow questions."""

import json

import pytest

from atlasweave.plans import question_bank as bank
from atlasweave.sources.flows import read_flows, resolved

FLOW = {
    "id": "meals", "title": "Meals", "version": "1.2", "config": {"limit": {"salt": {"max": 3, "unit": "g"}, "tags": ["a", "b"]}, "strict": True, "none": {}},
    "entrypoints": {"cook": "prep"}, "phases": [{"id": "cook", "title": "Cook", "nodes": ["prep", "taste"]}],
    "nodes": [
        {"id": "prep", "type": "deterministic", "name": "Prepare", "description": "cuts", "uses_ocr": False, "inputs": ["list", "old"], "inputs_optional": ["old"], "outputs": ["dish"], "metrics": ["salt"],
         "outcomes": {"ok": "went well", "bad": None}, "retry": {"max_attempts": 2},
         "action": {"kind": "command", "implemented": True, "command": "python {skill_dir}/bin/prep.py --strict config.strict --x config.limit.salt.max.now", "prompt_ref": "not one"},
         "validations": [
             {"id": "salty", "description": "not too salty", "kind": "metric", "check": "metrics.salt <= config.limit.salt.max and metrics.heat > state.nodes.taste.metrics.heat", "blocking": True, "on_fail": "bad"},
             {"id": "whole", "description": "complete", "kind": "schema", "check": "metrics.none config.none.x", "blocking": "state.strict", "on_fail": "bad"}]},
        {"id": "read", "type": "claude", "name": "Read", "description": "reads", "action": {"kind": "claude", "implemented": True, "prompt_ref": "p.md", "prompt_version": "3", "writes_only": ["x", "y"]}},
        {"id": "taste", "type": "human", "name": "Taste", "description": "tastes", "inputs": ["dish"], "outcomes": {"done": "fine"}, "action": {"kind": "human_review", "review_page": "t.html", "decision_options": ["yes", "no"], "required_fields": ["who"]}},
        {"id": "end", "type": "terminal", "name": "End", "description": "over"},
    ],
    "artifacts": {
        "list": {"path": "list.txt", "format": "text", "description": "the list", "produced_by": "shop"},
        "old": {"path": "old.json", "format": "json", "description": "the last dish", "optional": True, "produced_by": "prep"},
        "dish": {"path": "dish.json", "format": "json", "description": "the dish", "produced_by": "prep", "key_fields": ["name", "parts[].id"]},
    },
    "edges": [
        {"id": "e1", "from": "prep", "on": "ok", "to": "taste", "priority": 2, "guard": "metrics.salt < config.limit.sugar.max and state.round > 1 and state.nodes.taste.metrics.heat > 0", "effects": [{"op": "inc", "path": "round"}, {"op": "set", "path": "x.y"}]},
        {"id": "e2", "from": "taste", "on": "done", "to": "$resume"},
    ],
}
BINDINGS = {"concepts": {"meal": {"label": "Meal", "definition": "what is eaten", "artifacts": ["dish"]}}, "invariants": {"salt": {"statement": "salt is bounded", "enforced_by": {"prep": ["salty"]}}}}


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        (folder / f"{name}.json").write_text(content if isinstance(content, str) else json.dumps(content))


@pytest.fixture(scope="module")
def flows(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("flows")
    put(root / "meals", flow=FLOW, bindings=BINDINGS, other={"id": "no flow"})
    (root / "meals" / "bin").mkdir()
    (root / "meals" / "bin" / "prep.py").write_text("pass")
    step = {"id": "only", "type": "ocr", "name": "Only", "description": "one", "action": {"kind": "command", "command": "python gone.py config.strict"}}
    put(root / "small", flow={"id": "small", "title": "Small", "version": "1", "config": {}, "phases": [], "nodes": [step], "artifacts": {}, "edges": []})
    put(root / "torn", flow="{")
    put(root / "nameless", flow={"title": "x"})
    put(root / "zweit", flow={"id": "small", "title": "Again", "version": "1"})
    put(root / "twice", flow={"id": "twice", "nodes": [step | {"name": "a"}, step | {"name": "b"}]})
    return read_flows(spark, str(root))


def rows(flows, question, *columns, what="answer"):
    found = bank.ask(flows.graph, question)[what]
    strip = lambda v: v.replace("flow/meals/", "") if isinstance(v, str) else v
    return {tuple(map(strip, r)) for r in found.where("param NOT LIKE 'flow/small/%'").select(*columns).collect()}


SALTY, WHOLE = "step/prep/check/salty", "step/prep/check/whole"
ANSWERS = [
    ("FL01", ("param", "type", "step_id", "uses_ocr"), {("step/prep", "DeterministicStep", "prep", None), ("step/read", "ClaudeStep", "read", None), ("step/taste", "HumanStep", "taste", None), ("step/end", "TerminalStep", "end", None)}),
    ("FL02", ("param", "artifact", "direction", "path"), {("step/prep", "artifact/list", "input", "list.txt"), ("step/prep", "artifact/old", "input (optional)", "old.json"), ("step/prep", "artifact/dish", "output", "dish.json"), ("step/taste", "artifact/dish", "input", "dish.json")}),
    ("FL03", ("param", "path"), {("step/prep", "name"), ("step/prep", "parts[].id")}),
    ("FL04", ("param", "check", "blocking", "on_fail", "metric", "parameter", "value"), {("step/prep", "salty", "true", "bad", m, "limit.salt.max", "3") for m in ("salt", "heat")} | {("step/prep", "whole", "state.strict", "bad", None, None, None)}),
    ("FL05", ("param", "metric"), {("step/prep", "salt")}),
    ("FL06", ("param", "parameter", "value", "via"), {("step/prep", "limit.salt.max", "3", "check"), ("step/prep", "limit.salt.max", "3", "command/action"), ("step/prep", "strict", "true", "command/action")}),
    ("FL07", ("param", "statement"), {("step/prep", "salt is bounded")}),
    ("FL08", ("param", "mode", "spec", "exists"), {("step/prep", "command", FLOW["nodes"][0]["action"]["command"], "true"), ("step/read", "prompt", "p.md", None), ("step/taste", "review page", "t.html", None)}),
    ("FL09", ("param", "artifact", "consumer"), {("step/prep", "artifact/dish", "taste")}),
    ("FL10", ("param", "label"), {("step/prep", "Meal"), ("step/taste", "Meal")}),
    ("FL11", ("param", "outcome", "priority", "to"), {("step/prep", "ok", "2", "taste"), ("step/taste", "done", "0", "$resume")}),
    ("FL12", ("param", "kind"), {("step/prep", "pass_case"), ("step/prep", "fail_case"), ("step/prep", "route"), ("step/taste", "route"), ("step/prep", "property")}),
    ("FL13", ("t", "state_path"), {("edge/e1", "state.round"), ("edge/e1", "state.nodes.taste.metrics.heat"), ("edge/e1", "state.nodes.prep.metrics.salt")}),
    ("FL14", ("step", "option", "required_field"), {("taste", "yes", "who"), ("taste", "no", "who")}),
    ("FL15", ("step", "implemented"), {("prep", "true"), ("read", "true"), ("only", "false")}),
    ("FL16", ("param", "kind", "step"), {("param/limit.salt.max", "check", "prep"), ("param/limit.salt.max", "step action", "prep"), ("param/limit.salt.max", "test", "prep"), ("param/limit.sugar.max", "transition", "prep"), ("param/strict", "step action", "prep")}),
    ("FL17", ("param", "role", "step"), {("artifact/dish", "writer", "prep"), ("artifact/dish", "reader", "taste"), ("artifact/list", "reader", "prep"), ("artifact/old", "reader (optional)", "prep")}),
]


@pytest.mark.parametrize("question, columns, want", ANSWERS, ids=[a[0] for a in ANSWERS])
def test_a_folder_answers_every_flow_question(flows, question, columns, want):
    assert rows(flows, question, *columns) == want


def test_gaps(flows):
    assert rows(flows, "FL03", "artifact", what="gaps") == set()
    assert rows(flows, "FL05", "metric", what="gaps") == {("heat",)}
    assert rows(flows, "FL11", "outcome", what="gaps") == {("bad",)}
    assert {(r.subject, r.rel, r.name) for r in flows.unresolved.collect()} == {("flow/meals/edge/e1", "usesParameter", "limit.sugar.max"), ("flow/small/step/only", "usesParameter", "strict")}


def test_values_and_files(flows):
    values = {(r.subj, r.pred): r.value for r in flows.graph.literals.where("subj NOT LIKE '%/step/%' AND pred IN ('value', 'exists', 'statePath', 'sourceRef')").collect()}
    assert values["flow/meals/param/limit.tags", "value"] == '["a","b"]' or json.loads(values["flow/meals/param/limit.tags", "value"]) == ["a", "b"]
    assert values["flow/meals/impl/bin/prep.py", "exists"] == "true" and values["flow/small/impl/gone.py", "exists"] == "false"
    assert values["flow/meals/edge/e1/effect/1", "statePath"] == "state.x.y" and values["flow/meals/param/limit.salt.max", "sourceRef"] == "flow.json#/config/limit/salt/max"
    assert ("flow/meals/param/none", "value") not in values
    read = {tuple(r) for r in flows.graph.literals.where("pred = 'readsStatePath' AND subj LIKE '%/check/%'").select("subj", "value").collect()}
    assert read == {(f"flow/meals/{SALTY}", "state.nodes.taste.metrics.heat")}, "only checks of metrics read the state"
    made = {tuple(r) for r in flows.graph.edges.where("rel = 'producedBy'").select("src", "dst").collect()}
    assert made == {(f"flow/meals/artifact/{a}", "flow/meals/step/prep") for a in ("old", "dish")}, "no edge to a step that isn't there"


def test_skipped_folders_are_named(flows):
    assert {(r.scope, r.error.split(" column")[0]) for r in flows.skipped.where("scope <> 'torn'").collect()} == {("zweit", "flow id is taken"), ("nameless", "flow has no id"), ("twice", "nodes need different ids")}
    assert flows.skipped.where("scope = 'torn'").count() == 1
    assert flows.graph.nodes.where("id LIKE 'flow/twice%' OR label = 'Again'").isEmpty()


def test_longest_known_name(spark):
    names = spark.createDataFrame([("s", "a.b.c"), ("s", "a.bc"), ("s", "b"), ("t", "a.b.c")], "scope string, name string")
    known = spark.createDataFrame([("s", "a"), ("s", "a.b"), ("s", "a.b"), ("u", "b")], "scope string, prefix string")
    assert {tuple(r) for r in resolved(names, known).collect()} == {("s", "a.b.c", "a.b"), ("s", "a.bc", "a"), ("s", "b", None), ("t", "a.b.c", None)}


def test_unknown_parameter_value(flows):
    with pytest.raises(KeyError, match="nowhere"):
        bank.ask(flows.graph, "FL02", "nowhere")
    assert bank.ask(flows.graph, "FL02", "flow/meals/step/taste")["answer"].count() == 1


def test_no_flows(spark, tmp_path):
    put(tmp_path / "x", other={"a": 1})
    found = read_flows(spark, str(tmp_path))
    assert found.graph.nodes.isEmpty() and found.skipped.isEmpty() and found.unresolved.isEmpty()
