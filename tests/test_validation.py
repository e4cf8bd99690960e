"""Documents against schemas and against each other: one planted fault of each kind is found at its path."""

import json

import pytest

from atlasweave.operators import validation
from atlasweave.sources import documents, export, incremental, reports

SCHEMA = {
    "type": "object",
    "required": ["report", "sections"],
    "additionalProperties": False,
    "properties": {
        "report": {"type": "object", "required": ["id", "version"], "properties": {"id": {"type": "string", "pattern": "^[a-z0-9-]+$"}, "version": {"$ref": "#/$defs/semver"}, "owner": {"type": ["string", "null"]}, "locales": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"enum": ["en", "fr"]}}}},
        "sections": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["id", "title"], "additionalProperties": False, "properties": {"id": {"type": "string", "pattern": "^[a-z_]+$"}, "title": {"type": "string", "minLength": 3}, "rank": {"type": "integer", "minimum": 1, "exclusiveMaximum": 10}}}},
        "fields": {"type": "object", "additionalProperties": {"$ref": "#/$defs/field"}},
        "files": {"type": "object", "additionalProperties": {"type": "string", "maxLength": 4}},
        "size": {"oneOf": [{"type": "integer"}, {"type": "string", "pattern": "^big$"}]},
        "tree": {"$ref": "#/$defs/tree"},
    },
    "$defs": {
        "semver": {"type": "string", "pattern": r"^\d+\.\d+\.\d+$"},
        "field": {"allOf": [{"type": "object", "required": ["type"]}, {"properties": {"type": {"enum": ["text", "list"]}, "row": {"type": "string"}, "column": {"type": "string"}, "status": {"const": "ok"}}}], "if": {"properties": {"type": {"const": "list"}}}, "then": {"required": ["row"]}, "additionalProperties": False},
        "tree": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "below": {"$ref": "#/$defs/tree"}}},
    },
}
GOOD = {"report": {"id": "r-1", "version": "1.0.2", "owner": None, "locales": ["en", "fr"]}, "sections": [{"id": "top", "title": "Top", "rank": 1}], "fields": {"a": {"type": "text"}, "b": {"type": "list", "row": "x"}}, "files": {"a/b.c": "x"}, "size": "big", "tree": {"name": "n", "below": {"name": "m"}}}


def facts_of(spark, *documents_):
    rows = [(f"s{i}", "report.json", path, value) for i, d in enumerate(documents_) for path, value in documents.facts_of(d)]
    return spark.createDataFrame(rows, "scope string, file string, fact string, value string")


def changed(**parts):
    out = json.loads(json.dumps(GOOD))
    for path, value in parts.items():
        at, *steps = path.split("__")
        place = out
        for s in [at, *steps][:-1]:
            place = place[int(s) if isinstance(place, list) else s]
        if value is ...:
            del place[[at, *steps][-1]]
        else:
            place[[at, *steps][-1]] = value
    return out


def test_each_kind_of_fault_is_found_at_its_path(spark):
    planted = [
        (GOOD, set()),
        (changed(report__id="Bad Id"), {("report.id", "doesn't match ^[a-z0-9-]+$")}),
        (changed(report__version=3), {("report.version", "is not of type string")}),
        (changed(report__owner=7), {("report.owner", "is not of type string or null")}),
        (changed(report__version=...), {("report.version", "is missing")}),
        (changed(sections=...), {("sections", "is missing")}),
        (changed(report__locales=["en", "de"]), {("report.locales", "has a value that is not one of the options")}),
        (changed(report__locales=["en", "en"]), {("report.locales", "has a value twice")}),
        (changed(report__locales=[]), {("report.locales", "has fewer than 1 values")}),
        (changed(sections__0__title="T"), {("sections.top.title", "is shorter than 3")}),
        (changed(sections__0__title=...), {("sections.top.title", "is missing")}),
        (changed(sections__0__rank=10), {("sections.top.rank", "is above the range")}),
        (changed(sections__0__rank=1.5), {("sections.top.rank", "is not of type integer")}),
        (changed(sections__0__id="Top9"), {("sections.Top9.id", "doesn't match ^[a-z_]+$")}),
        (changed(sections__0__extra=1), {("sections.top.extra", "extra isn't declared")}),
        (changed(sections=[{"title": "No id"}]), {("sections.0.id", "is missing")}),
        (changed(other=1), {("other", "other isn't declared")}),
        (changed(fields__b__row=...), {("fields.b.row", "is missing with this type")}),
        (changed(fields__a__type="date"), {("fields.a.type", "is not one of the options")}),
        (changed(fields__a={}), {("fields.a.type", "is missing")}),
        (changed(fields__a__status="no"), {("fields.a.status", 'is not "ok"')}),
        (changed(files={"a/b.c": "12345"}), {("files.a/b.c", "is longer than 4")}),
        (changed(size="small"), {("size", "fits none of the alternatives")}),
        (changed(tree__below__name=...), {("tree.below.name", "is missing")}),
        (changed(report=3), {("report", "is not of type object")}),
    ]
    found = validation.validate(facts_of(spark, *[d for d, _ in planted]), {"report": SCHEMA}, files=("report",))
    by_scope = {}
    for r in found.collect():
        assert r.severity == "error" and r.file == "report.json"
        by_scope.setdefault(int(r.scope[1:]), set()).add((r.path, r.message))
    assert by_scope == {i: want for i, (_, want) in enumerate(planted) if want}
    assert [tuple(r) for r in validation.validate(facts_of(spark, GOOD), {"report": SCHEMA}, files=("report", "lineage")).collect()] == [("s0", "error", "lineage", "", "the file is missing")]


def folder(tmp_path, scope, number, lineage=None, **report):
    place = tmp_path / scope
    place.mkdir(parents=True, exist_ok=True)
    base = {"report": {"id": f"r{number}", "title": "t", "parameters": [{"name": "fund", "meaning": "m"}]}, "sections": [{"id": "top", "fields": ["nav"]}], "fields": {"nav": {"type": "text"}}}
    (place / "report.json").write_text(json.dumps({**base, **report}))
    (place / "lineage.json").write_text(json.dumps(lineage or {"source": {"name": "s"}, "table": {"name": "t"}, "fields": {"nav": {"status": "proposed", "column": "nav"}}}))


def test_documents_against_each_other(spark, tmp_path):
    folder(tmp_path, "good", 1)
    folder(tmp_path, "ghost", 2, sections=[{"id": "top", "fields": ["nav", "ghost"]}, {"id": "low", "fields": ["ghost"]}])
    folder(tmp_path, "loose", 3, fields={"nav": {"type": "text"}, "free": {"type": "text"}}, lineage={"table": {"name": "t"}, "fields": {"nav": {"status": "proposed"}, "free": {"status": "unmapped", "column": "c"}, "odd": {"status": "unmapped"}}})
    folder(tmp_path, "bare", 4, lineage={"fields": {"nav": {"status": "verified", "column": "c"}}, "parameters": {"desk": "d"}})
    facts = documents.read_facts(spark, str(tmp_path))
    found = {(r.scope, r.severity, r.file, r.path, r.message) for r in validation.unmet(facts).collect()}
    assert found == {
        ("ghost", "error", "report.json", "sections.low.fields", "a section names a field that isn't defined: ghost"),
        ("loose", "error", "report.json", "fields.free.type", "the field stands in no section: free"),
        ("loose", "error", "lineage.json", "fields.odd.status", "lineage names a field that isn't defined: odd"),
        ("loose", "error", "lineage.json", "fields.nav.status", "a mapped field names no column: nav"),
        ("loose", "error", "lineage.json", "fields.free.column", "an unmapped field names a column: free"),
        ("loose", "warn", "lineage.json", "table.name", "a table is named, but no data source: source"),
        ("bare", "error", "lineage.json", "fields.nav.column", "columns are named, but no table: table"),
        ("bare", "error", "lineage.json", "parameters.desk", "lineage binds a parameter that isn't declared: desk"),
    }
    # errors leave a folder out of the catalogue, and stop an export
    graph, skipped = reports.read_reports(spark, str(tmp_path), validation.unmet)
    assert {r.scope for r in skipped.collect()} == {"ghost", "loose", "bare"} and [r.id for r in graph.nodes_of(["ReportType"]).collect()] == ["report/r1"]
    store = str(tmp_path / "store")
    assert {r.scope for r in incremental.refresh(spark, str(tmp_path), store, validation.unmet).skipped.collect()} == {"ghost", "loose", "bare"}
    with pytest.raises(export.ExportRefused):
        export.export(graph, str(tmp_path / "out"), {}, validation.unmet(facts))
