"""Catalogues that read what has changed, and contracts that are accepted."""

import json
import os

import pytest

from atlasweave.functions.digest import digest_of
from atlasweave.operators import acceptance
from atlasweave.sources import incremental, reports, versions


def put(folder, scope, number, **more):
    (folder / scope / "semantic").mkdir(parents=True, exist_ok=True)
    report = {"report": {"id": f"r{number}", "title": f"Report {number}", "purpose": "p", "parameters": [{"name": "fund", "meaning": "a fund"}]}, "sections": [{"id": "top", "component": "table", "fields": ["nav"]}], "fields": {"nav": {"type": "currency", "meaning": "value", **more}}}
    (folder / scope / "semantic" / "report.json").write_text(json.dumps(report))
    (folder / scope / "semantic" / "lineage.json").write_text(json.dumps({"table": {"dataset": "d", "name": "t"}, "source": {"name": f"s{number % 2}"}, "fields": {"nav": {"status": "proposed", "column": "nav"}}}))


def parts(graph):
    return [sorted(map(tuple, t.collect()), key=str) for t in (graph.nodes.select("id", "type", "label"), graph.edges.select("src", "rel", "dst"), graph.literals.select("subj", "pred", "value"))]


def equals_a_full_read(spark, folder, found):
    whole, skipped = reports.read_reports(spark, str(folder))
    assert parts(found.graph) == parts(whole)
    assert sorted(map(tuple, found.skipped.collect())) == sorted(map(tuple, skipped.collect()))


def test_only_changed_folders_are_parsed(spark, tmp_path):
    folder, store = tmp_path / "reports", str(tmp_path / "store")
    for i in range(6):
        put(folder, f"f{i}", i)
    first = incremental.refresh(spark, str(folder), store)
    assert first.parsed == 12 and first.version.number == 1
    equals_a_full_read(spark, folder, first)
    again = incremental.refresh(spark, str(folder), store)
    assert again.parsed == 0 and again.version == first.version and parts(again.graph) == parts(first.graph)
    put(folder, "f2", 2, rules=["must be positive"])  # a changed file
    changed = incremental.refresh(spark, str(folder), store)
    assert changed.parsed == 2 and changed.digest != first.digest
    equals_a_full_read(spark, folder, changed)
    os.remove(folder / "f3" / "semantic" / "lineage.json")  # a removed file, a removed folder, a new one
    os.remove(folder / "f4" / "semantic" / "lineage.json")
    os.remove(folder / "f4" / "semantic" / "report.json")
    put(folder, "g", 9)
    moved = incremental.refresh(spark, str(folder), store)
    assert moved.parsed == 3
    equals_a_full_read(spark, folder, moved)
    before = moved.digest
    (folder / "g").rename(folder / "h")  # the report stays the same one
    renamed = incremental.refresh(spark, str(folder), store)
    assert renamed.parsed == 2 and renamed.digest == before
    equals_a_full_read(spark, folder, renamed)


def test_broken_and_second_reports_are_left_out_until_they_are_mended(spark, tmp_path):
    folder, store = tmp_path / "reports", str(tmp_path / "store")
    put(folder, "a", 1)
    put(folder, "b", 1)  # the same id
    put(folder, "c", 3)
    (folder / "c" / "semantic" / "lineage.json").write_text("{broken")
    found = incremental.refresh(spark, str(folder), store)
    assert sorted(r.scope for r in found.skipped.collect()) == ["b", "c"]
    equals_a_full_read(spark, folder, found)
    put(folder, "a", 7)  # the id is free now
    put(folder, "c", 3)
    mended = incremental.refresh(spark, str(folder), store)
    assert mended.parsed == 4 and mended.skipped.collect() == []
    equals_a_full_read(spark, folder, mended)


TERM = "vocabulary string, term string, kind string, domain array<string>, range array<string>, inverse string, label string, definition string, rationale string, alternatives string, validated_by string, validated_on string"


def contract_of(spark, version, *terms):
    return acceptance.Contract(spark.createDataFrame([("data", *t) for t in terms], TERM), spark.createDataFrame([("data", version)], "vocabulary string, version string"))


def term(name, definition="d", who=None, when=None, domain=("A",), why=None):
    return (name, "object", list(domain), ["B"], None, name, definition, why, None, who, when)


def test_contracts_are_accepted_with_their_log(spark, tmp_path):
    store = str(tmp_path)
    first = contract_of(spark, "1.0.0", term("a", who="dana", when="2026-01-05"), term("b"))
    with pytest.raises(acceptance.AcceptRefused):
        acceptance.accept(spark, store, first, "<you>", "2026-01-06")
    one = acceptance.accept(spark, store, first, "dana", "2026-01-06")
    assert one.number == 1 and one.meta["accepted_by"] == "dana" and one.meta["digest"] == digest_of(first.terms.select(one.read(spark, "terms").columns))
    assert acceptance.accept(spark, store, first, "dana", "2026-01-07") is None  # nothing to accept

    reworded = contract_of(spark, "1.0.1", term("a", "another text", "dana", "2026-01-05"), term("b", why="because"))
    seen = acceptance.review(spark, store, reworded)
    assert {tuple(r) for r in seen.changes.collect()} == {("data", "a", "definition", "cosmetic"), ("data", "b", "reasoning added", "cosmetic")}
    assert [tuple(r) for r in seen.reconfirm.collect()] == [("a", "definition", "dana", "2026-01-05")]
    renewed = contract_of(spark, "1.0.1", term("a", "another text", "dana", "2026-02-01"), term("b"))
    assert acceptance.review(spark, store, renewed).reconfirm.collect() == []

    breaking = contract_of(spark, "1.0.1", term("a", who="dana", when="2026-01-05", domain=()), term("b"), term("c"))
    with pytest.raises(acceptance.AcceptRefused, match="breaking: at least 2.0.0"):
        acceptance.accept(spark, store, breaking, "dana", "2026-03-01")
    with pytest.raises(acceptance.AcceptRefused, match="went back"):
        acceptance.accept(spark, store, contract_of(spark, "0.9.0", term("a", who="dana", when="2026-01-05"), term("b")), "dana", "2026-03-01")
    two = acceptance.accept(spark, store, reworded, "erin", "2026-03-02", seen)
    assert two.number == 2
    with pytest.raises(versions.Conflict):  # a review of an older version
        acceptance.accept(spark, store, reworded, "dana", "2026-03-02", seen)
    log = {(str(r.at)[:10], r.by, r.subject, r.change) for r in acceptance.changelog(spark, store).collect()}
    assert log == {("2026-01-06", "dana", "data", "first accepted, terms: 2"), ("2026-03-02", "erin", "a", "definition"), ("2026-03-02", "erin", "b", "reasoning added")}
