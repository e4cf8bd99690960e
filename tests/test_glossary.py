"""Term cards, citations, listings and the state of a history."""

from datetime import datetime

from atlasweave.operators import glossary


def test_cards_and_citations(spark):
    terms = spark.createDataFrame([("Field", "class", "a figure [CQ1, CQ4-5]", [], []), ("has", "object", "holds", ["Report", "Part"], ["Field"]), ("id", "data", "name", ["Field"], ["string"])], "term string, kind string, definition string, domain array<string>, range array<string>")
    found = {r.term: (r.properties, r.referenced_by) for r in glossary.cards(terms).collect()}
    assert found == {"Field": (["id"], ["has"]), "has": ([], []), "id": ([], [])}
    questions = spark.createDataFrame([("CQ9", ["id", "other"])], "question string, uses array<string>")
    assert {tuple(r) for r in glossary.asked_by(terms, questions).collect()} == {("Field", "CQ1"), ("Field", "CQ4"), ("Field", "CQ5"), ("id", "CQ9")}
    listed = spark.createDataFrame([("CQ1", "FIELD", True), ("CQ2", "REPORT", False)], "question string, params string, has_gaps boolean")
    briefs = spark.createDataFrame([("b", "CQ1"), ("a", "CQ1")], "task string, question string")
    assert {r.question: r.tasks for r in glossary.listing(listed, briefs).collect()} == {"CQ1": "a,b", "CQ2": ""}
    uses = spark.createDataFrame([("id",), ("id",), ("has",)], "term string")
    assert [tuple(r) for r in glossary.rank_terms(terms, uses, 2).collect()] == [("id", 2), ("has", 1)]


def test_history_state(spark):
    changes = spark.createDataFrame([("x", 1, datetime(2024, 1, 1), None, "a", "baseline", "1")], "scope string, revision long, at timestamp, effective timestamp, fact string, kind string, value string")
    now = spark.createDataFrame([("x", "a", "2"), ("y", "a", "1")], "scope string, fact string, value string")
    assert {(r.scope, r.revisions, r.pending) for r in glossary.history_state(changes, now).collect()} == {("x", 1, 1), ("y", 0, None)}
