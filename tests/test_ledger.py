"""Laws of the ledger: replay after a revision gives the facts, a diff applied gives the other side, faults are found."""

import random
from datetime import datetime

import pytest

from atlasweave.operators import ledger

CHANGES = "scope string, revision long, at timestamp, effective timestamp, fact string, kind string, previous string, value string"
DAY = lambda d: datetime(2024, 1, d)


def facts(df):
    return {(r.scope, r.fact): r.value for r in df.collect()}


def test_replay_against_a_loop(spark):
    rng = random.Random(5)
    rows = []
    for scope in "xyz":
        for revision in range(1, 9):
            for fact in rng.sample("abcd", 2):
                kind = "baseline" if revision == 1 or rng.random() < 0.1 else rng.choice(["changed", "added", "removed"])
                rows.append((scope, revision, DAY(revision), DAY(rng.randrange(1, 12)) if rng.random() < 0.7 else None, fact, kind, None, str(rng.randrange(9))))
    df = spark.createDataFrame(rows, CHANGES)
    for as_of, known_on in ((None, None), ("2024-01-05", None), (None, "2024-01-04"), ("2024-01-06", "2024-01-07")):
        state: dict = {}
        for scope in "xyz":
            for revision in range(1, 9):
                here = [r for r in rows if r[:2] == (scope, revision) and (not as_of or (r[3] or r[2]) <= datetime.fromisoformat(as_of)) and (not known_on or r[2] <= datetime.fromisoformat(known_on))]
                if any(r[5] == "baseline" for r in here):
                    state = {k: v for k, v in state.items() if k[0] != scope}
                for r in here:
                    state[scope, r[4]] = r[7]
                    if r[5] == "removed":
                        del state[scope, r[4]]
        assert facts(ledger.replay(df, as_of, known_on)) == state


def test_accepting_the_facts_makes_replay_give_them(spark):
    log = spark.createDataFrame([("x", 1, DAY(1), None, "a", "baseline", None, "1"), ("x", 1, DAY(1), None, "b", "baseline", None, None)], CHANGES)
    now = spark.createDataFrame([("x", "a", "2"), ("x", "c", None), ("y", "a", "1")], "scope string, fact string, value string")
    with pytest.raises(ValueError, match="why"):
        ledger.next_revision(log, now, "someone", None, "2024-01-02")
    with pytest.raises(ValueError, match="person"):
        ledger.next_revision(log, now, "<name>", "because", "2024-01-02")
    new = ledger.next_revision(log, now, "someone", "because", "2024-01-02")
    grown = log.unionByName(new.select(*log.columns))
    assert facts(ledger.replay(grown)) == facts(now)
    assert {r.revision for r in new.where("scope = 'y'").collect()} == {1}
    assert ledger.next_revision(grown, now, "someone", None, "2024-01-03").count() == 0
    assert ledger.integrity(grown).count() == 0


def test_diff_and_apply_round_trip(spark):
    schema = "scope string, fact string, value string"
    a = spark.createDataFrame([("x", "same", "1"), ("x", "gone", "1"), ("x", "new value", None), ("x", "null", None)], schema)
    b = spark.createDataFrame([("x", "same", "1"), ("x", "new value", "2"), ("x", "null", None), ("x", "extra", None)], schema)
    d = ledger.diff(a, b)
    assert {(r.fact, r.kind) for r in d.collect()} == {("gone", "removed"), ("new value", "changed"), ("extra", "added")}
    assert facts(ledger.apply_diff(a, d)) == facts(b)


def test_integrity_finds_each_fault(spark):
    rows = [("x", 1, DAY(5), None, "a", "baseline", None, "1"), ("x", 3, DAY(4), None, "a", "changed", "7", "2"), ("x", 4, DAY(6), None, "b", "baseline", None, "1")]
    found = {(r.revision, r.problem) for r in ledger.integrity(spark.createDataFrame(rows, CHANGES)).collect()}
    assert found == {(3, "number"), (4, "number"), (3, "time goes back"), (4, "late baseline"), (3, "doesn't start from the held value")}


def test_lifecycle_rules(spark):
    stages = ["inception", "saved", "checked", "live"]
    log = [("a", 1, DAY(1), "inception"), ("a", 2, DAY(2), "checked"), ("b", 1, DAY(1), "saved"), ("c", 1, DAY(3), "inception"), ("c", 2, DAY(2), "saved"), ("d", 1, DAY(1), "inception"), ("d", 2, DAY(2), "saved"), ("d", 3, DAY(3), "inception"), ("e", 1, DAY(1), "odd")]
    df = spark.createDataFrame(log, "scope string, seq int, at timestamp, status string")
    assert {(r.scope, r.problem) for r in ledger.lifecycle(df, stages).collect()} == {("a", "skips a status"), ("b", "first status"), ("c", "time goes back"), ("e", "unknown status")}
    assert {r.scope: r.status for r in ledger.current_status(df).collect()}["d"] == "inception"
    releases = spark.createDataFrame([("a", False), ("a", None), ("c", True), ("z", True)], "scope string, frozen boolean")
    assert [(r.scope, r.seq, r.status) for r in ledger.unfrozen(df, releases, "checked").collect()] == [("a", 2, "checked")]
    assert ledger.unfrozen(df, releases, "saved").where("scope = 'c'").count() == 0


def test_only_scopes_without_violations_are_accepted(spark):
    log = spark.createDataFrame([(s, 1, DAY(1), None, "a", "baseline", None, "1") for s in ("good", "bad", "absent")], CHANGES)
    now = spark.createDataFrame([("good", "a", "2"), ("bad", "a", "2"), ("new", "a", "1")], "scope string, fact string, value string")
    findings = spark.createDataFrame([("bad", "Violation"), ("bad", "error"), ("good", "Warning"), ("new", None), ("other", "error")], "scope string, severity string")
    rows, refused = ledger.accept(log, now, findings, "someone", "because", "2024-02-02", "2024-03-01")
    assert {(r.scope, r.revision, r.fact, r.kind, r.previous, r.value) for r in rows.collect()} == {("good", 2, "a", "changed", "1", "2"), ("new", 1, "a", "baseline", None, "1")}
    assert {str(r.effective)[:10] for r in rows.collect()} == {"2024-03-01"}
    assert [tuple(r) for r in refused.collect()] == [("bad", 2)]


def test_last_set(spark):
    rows = [("x", 1, DAY(1), None, "a", "baseline", None, "1"), ("x", 2, DAY(2), None, "a", "changed", "1", "2"), ("x", 3, DAY(3), None, "a", "baseline", None, "2"), ("x", 3, DAY(3), None, "b", "removed", None, None)]
    assert [(r.fact, r.value, r.since) for r in ledger.last_set(spark.createDataFrame(rows, CHANGES)).collect()] == [("a", "2", DAY(2))]
