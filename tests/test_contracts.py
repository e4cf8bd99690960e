"""Shapes, change control, requirements, documents, export and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from atlasweave.operators import contract, requirements, shapes
from atlasweave.sources import documents, export
from atlasweave.sources.lift import EDGES, LITERALS, NODES, Graph
from atlasweave.streaming import ledger_stream


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("a", "Field", "a"), ("b", "Field", "b"), ("c", "Column", "c")]
    edges = [("a", "from", "c"), ("b", "inSection", "s1"), ("b", "inSection", "s2")]
    literals = [("a", "type", "text"), ("a", "size", "12"), ("b", "type", "odd"), ("b", "size", "many"), ("a", "locale", "en"), ("a", "locale", "fr")]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(literals, LITERALS))


@pytest.mark.parametrize(
    "constraint, want",
    [
        (shapes.Count("from", least=1), {"b"}), (shapes.Count("inSection", most=1), {"b"}), (shapes.Count("inSection", 1, 1), {"a", "b"}), (shapes.one_of("type", ["text", "date"]), {"b"}), (shapes.pattern("type", "ex"), {"b"}),
        (shapes.between("size", 1, 20), {"b"}), (shapes.between("size", high=5), {"a", "b"}), (shapes.length("type", 4), {"b"}), (shapes.HasValue("locale", "fr"), {"b"}), (shapes.HasValue("type", "odd", wanted=False), {"b"}),
        (shapes.ExactlyOne(("from", "inSection")), set()), (shapes.ExactlyOne(("from", "locale")), {"a", "b"}),
        (shapes.Query("from", lambda g: g.nodes.select(F.col("id").alias("focus"), F.lit("no").alias("message"))), {"a", "b"}),
    ],
)
def test_each_constraint(graph, constraint, want):
    found = shapes.check(graph, [shapes.Shape("Field", (constraint,))])
    assert {r.focus for r in found.collect()} == want and found.columns == shapes.FINDING


def test_severity_decides_the_status(graph):
    checked = lambda severity: shapes.check(graph, [shapes.Shape("Field", (shapes.Count("from", least=1, severity=severity),))])
    assert shapes.conforms(checked("Violation")).first().status == "blocked"
    assert shapes.conforms(checked("Warning")).first().status == "incomplete"
    assert shapes.conforms(checked("Warning").limit(0)).first().status == "complete"
    assert shapes.grouped(checked("Warning")).first().subjects == "b"


def test_shape_and_question_changes(spark):
    schema = "shape string, target string, constraint string, argument string, level string, message string"
    old = [("s", "A", "least", "1", "Violation", "m"), ("s", "A", "most", "1", "Warning", "m"), ("t", "A", "in", "x", "Violation", "m")]
    new = [("s", "A", "least", "2", "Violation", "m"), ("s", "A", "most", "1", "Warning", "words"), ("u", "New", "least", "1", "Violation", "m"), ("v", "A", "in", "x", "Warning", "m")]
    found = contract.shape_changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), spark.createDataFrame([("New",)], "class string"))
    assert {tuple(r) for r in found.collect()} == {("s", "least", "changed", "breaking"), ("s", "most", "message", "cosmetic"), ("t", "in", "removed", "breaking"), ("u", "least", "added", "additive"), ("v", "in", "added", "additive")}
    schema = "question string, params array<string>, columns array<string>, digest string, wording string"
    old = [("a", ["P"], ["x", "y"], "1", "w"), ("b", [], ["x"], "1", "w"), ("c", [], ["x"], "1", "w"), ("d", [], ["x"], "1", "w"), ("e", [], ["x"], "1", "w")]
    new = [("a", ["Q"], ["x", "y"], "1", "w"), ("b", [], [], "2", "w"), ("c", [], ["x", "z"], "2", "w"), ("d", [], ["x"], "1", "v"), ("f", [], ["x"], "1", "w")]
    found = contract.question_changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    assert {tuple(r) for r in found.collect()} == {("a", "params", "breaking"), ("b", "columns removed", "breaking"), ("c", "columns added", "additive"), ("d", "wording", "cosmetic"), ("e", "removed", "breaking"), ("f", "added", "additive")}


def test_unconfirmed(spark):
    rows = [("a", "x", "2024-01-01"), ("b", "x", None), ("c", None, "2024-01-01"), ("d", "x", "2024-13-01"), ("e", "x", "soon"), ("f", None, None)]
    found = contract.unconfirmed(spark.createDataFrame(rows, "item string, validated_by string, validated_on string"))
    assert {tuple(r) for r in found.collect()} == {("b", "no date"), ("c", "no person"), ("d", "not a date"), ("e", "not a date")}


def test_notes_and_the_order_of_changes(spark):
    schema = "term string, rationale string, alternatives string, validated_by string, validated_on string"
    old = [("a", None, None, None, None), ("b", "r", "x", "p", "2024-01-01"), ("c", "r", None, "p", "2024-01-01"), ("d", None, None, None, None), ("gone", "r", None, None, None)]
    new = [("a", "r", None, None, None), ("b", "r", "y", None, None), ("c", "r", None, "p", "2024-02-01"), ("d", None, None, None, None), ("new", "r", None, None, None)]
    found = contract.notes_changed(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    assert {tuple(r) for r in found.collect()} == {("a", "reasoning added", "cosmetic"), ("b", "reasoning revised", "cosmetic"), ("b", "confirmation withdrawn", "cosmetic"), ("c", "confirmation revised", "cosmetic")}
    changes = [("x", "cosmetic"), ("z", "breaking"), ("y", "odd"), ("a", "breaking"), ("b", "additive")]
    assert [r.term for r in contract.by_severity(spark.createDataFrame(changes, "term string, severity string"), "term").collect()] == ["a", "z", "b", "x", "y"]


SCHEMA = {"type": "object", "required": ["id", "parts"], "properties": {"id": {"type": "string", "pattern": "^x"}, "kind": {"enum": ["a", "b"]}, "parts": {"type": "array", "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}}}, "if": {"properties": {"kind": {"const": "a"}}}, "then": {"required": ["why"]}}


def test_requirements(spark):
    found = {r.path: (r.type, r.required, r.options, r.depends) for r in requirements.requirements(spark, SCHEMA).collect()}
    assert found == {"id": ("string", True, None, None), "kind": ("any", False, "a,b", None), "parts": ("array", True, None, None), "parts[]": ("object", True, None, None), "parts[].n": ("integer", True, None, None), "why": ("any", True, None, "kind=a")}
    facts = spark.createDataFrame([("one", "id"), ("one", "parts.x.n"), ("two", "kind")], "scope string, fact string")
    assert {tuple(r) for r in requirements.missing(facts, requirements.requirements(spark, SCHEMA)).collect()} == {("two", "id"), ("two", "parts")}
    facts = spark.createDataFrame([("one", None), ("two", "id"), ("two", "id"), ("two", "parts")], "scope string, fact string")
    assert {tuple(r) for r in requirements.missing(facts, requirements.requirements(spark, SCHEMA)).collect()} == {("one", "id"), ("one", "parts")}
    assert requirements.missing(facts, requirements.requirements(spark, {"properties": {"a": {}}})).count() == 0


def test_references_of_a_schema():
    tree = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "children": {"type": "array", "items": {"$ref": "#/$defs/tree"}}}}
    schema = {"required": ["top"], "properties": {"top": {"$ref": "#/$defs/tree", "type": "map"}}, "$defs": {"tree": tree}}
    assert [(r[0], r[1], r[2]) for r in requirements.flatten(schema)] == [("top", "map", True), ("top.name", "string", True), ("top.children", "array", False), ("top.children[]", "object", False)]


def test_other_parents(spark):
    schema = "term string, kind string, domain array<string>, range array<string>, inverse string, label string, definition string, parents array<string>"
    row = lambda term, kind, parents: (term, kind, None, None, None, "l", "d", parents)
    old = spark.createDataFrame([row("a", "class", ["x", "y"]), row("b", "class", ["x"]), row("p", "object", None)], schema)
    new = spark.createDataFrame([row("a", "class", ["y", "x"]), row("b", "class", None), row("p", "object", ["q"])], schema)
    assert {tuple(r) for r in contract.term_changes(old, new).collect()} == {("b", "superclass", "breaking"), ("p", "subproperty", "additive")}


def test_folders_become_facts(spark, tmp_path):
    for scope, text in (("one", {"id": "a", "items": [{"id": "p", "v": 1}, {"id": "q", "v": [1, 2]}], "none": {}}), ("two", None)):
        (tmp_path / scope).mkdir()
        (tmp_path / scope / "doc.json").write_text(json.dumps(text) if text else "{broken")
    found = documents.read_facts(spark, str(tmp_path))
    assert {(r.fact, r.value) for r in found.where("scope = 'one'").collect()} == {("id", '"a"'), ("items", '["p", "q"]'), ("items.p.v", "1"), ("items.q.v", "[1, 2]"), ("none", "{}")}
    assert found.where("scope = 'two'").first().error


def test_a_class_is_checked_in_one_aggregation(spark, sf_dir):
    from atlasweave.plans import catalogue
    from atlasweave.sources.lift import lift

    plan = shapes.check(lift(spark, sf_dir), catalogue.SHAPES)._jdf.queryExecution().optimizedPlan().toString()
    for table, columns in (("orders", "o_orderpriority"), ("part", "p_brand"), ("customer", "c_mktsegment"), ("lineitem", "l_partkey")):
        assert sum("Relation" in line and columns in line for line in plan.splitlines()) == 1, table
    assert plan.count("Join") == 0


def test_several_values_and_messages_of_queries(spark):
    graph = Graph(spark.createDataFrame([("a", "F", "a"), ("b", "F", "b")], NODES), spark.createDataFrame([], EDGES), spark.createDataFrame([("a", "size", "99"), ("a", "size", "98"), ("a", "size", "98"), ("a", "size", "3"), ("z", "size", "77")], LITERALS))
    bad = shapes.check(graph, [shapes.Shape("F", (shapes.between("size", 1, 20), shapes.Count("size", 0))), shapes.Shape("F", (shapes.Count("size", most=2),))]).collect()
    assert sorted((r.focus, r.message) for r in bad) == [("a", "more than 2 values"), ("a", "not within 1..20"), ("a", "not within 1..20")]
    wide = shapes.Query("size", lambda g: g.literals.where("value > 98").select(F.col("subj").alias("focus"), "value"), message="{focus} is {value} wide", bound=("focus", "value"))
    assert [tuple(r) for r in shapes.check(graph, [shapes.Shape("F", (wide,))]).collect()] == [("Violation", "F", "a", "size", "a is 99 wide")]
    assert shapes.check(graph, [shapes.Shape("F", ())]).collect() == []


def test_entries_are_named_without_clashes():
    document = {"sections": [{"id": "order", "x": 1}, {"id": "a", "x": 2.0}], "twice": [{"name": "n", "v": 1}, {"name": "n", "v": 2}], "bare": [{"v": True}], "mixed": [1, {"a": 2}], "only": [{"id": "k"}], "none": []}
    assert dict(documents.facts_of(document)) == {
        "sections": '["order", "a"]', "sections.order.x": "1", "sections.a.x": "2.0", "twice.0.name": '"n"', "twice.0.v": "1", "twice.1.name": '"n"', "twice.1.v": "2",
        "bare.0.v": "true", "mixed": '[1, {"a": 2}]', "only": '["k"]', "only.k": "{}", "none": "[]",
    }


def test_facts_of_a_ledger(spark):
    facts = spark.createDataFrame([("s", "report.yaml", "a.b", "2.0", None), ("s", "report.yaml", "c", '"t\\"x"', None), ("s", "bad.json", None, None, "broken")], "scope string, file string, fact string, value string, error string")
    found = documents.ledger_facts(facts)
    assert {(r.fact, r.value) for r in found.collect()} == {("report.yaml → a.b", "2"), ("report.yaml → c", '"t\\"x"')}
    assert {r.t for r in found.select(documents.value_text(F.col("value")).alias("t")).collect()} == {"2", 't"x'}


def test_guessed_types(spark):
    rows = [("n", "1"), ("n", "-2.5"), ("p", "12.5 %"), ("d", "2024-01-02"), ("d", "01/02/2024"), ("b", "true"), ("c", "$1,200.50"), ("t", "1"), ("t", "x"), ("z", None)]
    assert {r.field: r.type for r in documents.skeleton(spark.createDataFrame(rows, "field string, value string")).collect()} == {"n": "number", "p": "percent", "d": "date", "b": "boolean", "c": "currency", "t": "text"}


def test_export_refuses_and_round_trips(spark, graph, tmp_path):
    with pytest.raises(export.ExportRefused):
        export.export(graph, str(tmp_path / "x"), {})
    sound = Graph(graph.nodes, graph.edges.where("rel = 'from'"), graph.literals)
    bad = spark.createDataFrame([("Violation",)], "severity string")
    with pytest.raises(export.ExportRefused):
        export.export(sound, str(tmp_path / "x"), {}, bad)
    export.export(sound, str(tmp_path / "x"), {"version": "1"})
    back = export.load(spark, str(tmp_path / "x"))
    assert back["nodes"].count() == 3 and [tuple(r) for r in back["edges"].select("source", "property", "target").collect()] == [("a", "from", "c")]
    assert json.loads(back["nodes"].where("id = 'a'").first().properties) == {"locale": ["en", "fr"], "size": ["12"], "type": ["text"]}


def test_stream_appends_once_and_keeps_rejects(spark, tmp_path):
    schema = "scope string, revision long, at timestamp, fact string, kind string"
    rows = spark.createDataFrame([("x", 1, "a", "baseline"), ("x", 0, "a", "changed"), ("x", 2, None, "changed"), ("x", 2, "a", "odd")], "scope string, revision long, fact string, kind string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # started again, it finds nothing new
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ledger_stream.append_changes(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/changes")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 3
    assert ledger_stream.change_rates(rows).where("kind = 'changed'").first().n == 2
