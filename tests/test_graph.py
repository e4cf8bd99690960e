"""Patterns, rules, navigation and lookup on small graphs, against brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from atlasweave.operators import atlas, lookup, projection, questions, rules, walk
from atlasweave.operators.patterns import Edge, Either, Label, Maybe, Node, NotEdge, Value, Where, match
from atlasweave.sources.lift import EDGES, LITERALS, NODES, Graph


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("a", "Step", "first"), ("b", "OcrStep", "second"), ("c", "Artifact", "file"), ("d", "Artifact", "other"), ("e", "Step", "alone")]
    edges = [("a", "writes", "c"), ("a", "reads", "c"), ("b", "reads", "c"), ("b", "reads", "d"), ("a", "next", "b"), ("a", "next", "a")]
    literals = [("a", "kind", "x"), ("a", "kind", "y"), ("b", "kind", "x"), ("c", "format", "json")]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(literals, LITERALS))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_classes_cover_their_kinds_only_when_told(graph):
    assert rows(match(graph, [Node("s", "Step")]), "s") == [("a",), ("e",)]
    assert rows(match(graph, [Node("s", "Step")], subclasses={"Step": ["OcrStep"]}), "s") == [("a",), ("b",), ("e",)]
    assert rows(match(graph, [Node("s", "Step|Artifact")]), "s") == [("a",), ("c",), ("d",), ("e",)]


def test_alternation_binds_once(graph):
    assert rows(match(graph, [Edge("s", "reads|writes", "x")]), "s", "x") == [("a", "c"), ("b", "c"), ("b", "d")]


def test_many_values_multiply_rows(graph):
    assert rows(match(graph, [Value("s", "kind", "k"), Edge("s", "reads", "x")]), "s", "k", "x") == [("a", "x", "c"), ("a", "y", "c"), ("b", "x", "c"), ("b", "x", "d")]


def test_optional_group_is_whole(graph):
    found = match(graph, [Node("s", "Step|OcrStep"), Maybe((Edge("s", "reads", "x"), Value("x", "format", "f")))])
    assert [tuple(r) for r in found.orderBy("s").collect()] == [("a", "c", "json"), ("b", "c", "json"), ("e", None, None)]


def test_unconnected_optional_goes_with_every_row(graph):
    assert match(graph, [Node("s", "Step"), Maybe((Value("z", "format", "f"),))]).count() == 2
    assert match(graph, [Node("s", "Step"), Maybe((Value("z", "none", "f"),))]).where("z IS NULL").count() == 2


def test_not_edge_and_wildcards(graph):
    assert rows(match(graph, [Node("x", "Artifact"), NotEdge("*", "writes", "x")]), "x") == [("d",)]
    assert rows(match(graph, [Node("s", "Step"), NotEdge("s", "reads|writes", "*")]), "s") == [("e",)]
    assert rows(match(graph, [Edge("s", "reads", "x"), NotEdge("s", "writes", "x")]), "s", "x") == [("b", "c"), ("b", "d")]
    assert rows(match(graph, [Edge("s", "next", "s")]), "s") == [("a",)]


def test_union_tags_and_filters(graph):
    found = match(graph, [Either("how", {"reads": (Edge("s", "reads", "x"),), "writes": (Edge("s", "writes", "x"),)}), Label("x", "name"), Where(F.col("name") == "file")])
    assert rows(found, "s", "how") == [("a", "reads"), ("a", "writes"), ("b", "reads")]
    assert match(graph, [Value("s", "kind", "k"), Where(F.lit(None).cast("boolean"))]).count() == 0
    with pytest.raises(TypeError):
        match(graph, ["no clause"])


def test_distinct_bindings(graph):
    assert match(graph, [Value("s", "kind", "k"), Edge("s", "reads", "x")], dedup=True).select("s").count() == 4


@pytest.mark.parametrize("gate, want", [("non_empty", {"a": "answered", "b": "gap", "e": "empty"}), ("gaps_only", {"a": "answered", "b": "gap", "e": "answered"}), ("any", dict.fromkeys("abe", "answered")), ("empty", {"a": "violated", "b": "violated", "e": "clean"})])
def test_status_precedence(spark, graph, gate, want):
    q = questions.Question("q", lambda g: match(g, [Edge("param", "reads", "x")]), lambda g: match(g, [Edge("param", "reads", "x"), NotEdge("*", "writes", "x")]), gate)
    found = questions.status(q, graph, spark.createDataFrame([("a",), ("b",), ("e",)], "param string"))
    assert {r.param: r.status for r in found.collect()} == want
    verdicts = questions.readiness(found, [questions.Brief("t", ("q",))]).collect()
    assert {r.param: (r.verdict, r.blockers) for r in verdicts} == {p: ("READY", "") if s in ("answered", "clean") else ("BLOCKED", "q") for p, s in want.items()}


def test_closure_ends_on_cycles(spark):
    rng = random.Random(4)
    pairs = {(str(rng.randrange(14)), str(rng.randrange(14))) for _ in range(20)} | {("0", "1"), ("1", "2"), ("2", "0")}
    want = set(pairs)
    while (grown := want | {(a, d) for a, b in want for c, d in want if b == c}) != want:
        want = grown
    got = rules.closure(spark.createDataFrame(sorted(pairs), "src string, dst string"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_fixpoint_adds_edges_only(spark, graph):
    rule = rules.Derive("far", "next", lambda g: match(g, [Edge("src", "next", "m"), Edge("m", "reads", "dst")]))
    found = rules.fixpoint(graph, [rule])
    new = {tuple(r) for r in found.edges.collect()} - {tuple(r) for r in graph.edges.collect()}
    assert new == {("a", "next", "c"), ("a", "next", "d")} and found.nodes.count() == graph.nodes.count()


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_hops_equal_breadth_first_search(spark, direction):
    rng = random.Random(7)
    edges = sorted({(f"n{rng.randrange(12)}", rng.choice("rs"), f"n{rng.randrange(12)}") for _ in range(18)})
    g = Graph(spark.createDataFrame([("n0", "N", "n")], NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame([], LITERALS))
    for depth in (1, 3, 9):
        frontier, seen, want = {"n0"}, {"n0"}, {}
        for hop in range(1, min(depth, 3) + 1):
            new = set()
            for s, r, d in edges:
                for at, to in ((s, d),) * (direction != "in") + ((d, s),) * (direction != "out"):
                    if at in frontier:
                        want.setdefault((s, r, d), hop)
                        new.add(to)
            frontier = new - seen
            seen |= new
        got = walk.hops(g, spark.createDataFrame([("n0",)], "id string"), depth, direction)
        assert {(r.src, r.rel, r.dst): r.hop for r in got.collect()} == want


def test_neighbors_says_that_there_are_more(spark, graph):
    start = spark.createDataFrame([("a",)], "id string")
    assert [r.truncated for r in walk.neighbors(graph, start, 1, limit=2).collect()] == [True, True]
    assert not walk.neighbors(graph, start, 1, rel="writes").first().truncated
    with pytest.raises(ValueError):
        walk.hops(graph, start, 1, "sideways")


def test_entity_card(spark, graph):
    found = walk.entity_card(graph, spark.createDataFrame([("c",)], "id string"))
    assert rows(found, "kind", "name", "other") == [("in", "reads", "a"), ("in", "reads", "b"), ("in", "writes", "a"), ("value", "format", "json")]


def test_did_you_mean_is_the_standard_librarys(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 12))) for _ in range(300)})
    df = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    for asked in ("abc de", "eeee", "b", "zzz"):
        want = difflib.get_close_matches(asked, sorted({" ".join(n.split()) for n in names}), 5, 0.6)  # names are compared, and given, in their normalised form
        assert [r.name for r in lookup.did_you_mean(df, asked).collect()] == want


def test_resolve_scores(spark):
    names = spark.createDataFrame([("x/Blue", "A", "sky"), ("y/1", "B", "blue"), ("y/2", "B", "dark_blue-ish"), ("y/3", "B", "nothing"), ("y/4", "A", "Blue")], "id string, type string, name string")
    assert [(r.id, r.score) for r in lookup.resolve(names, "blue", {"A": 0, "B": 1}).collect()] == [("x/Blue", 3), ("y/4", 2), ("y/1", 2), ("y/2", 1)]
    assert lookup.resolve(names, "blue", limit=1).first().more == 3
    assert lookup.resolve(names, "bl").count() == 0


def test_search_needs_all_words(spark):
    texts = spark.createDataFrame([(1, "net assets", "total net assets of the fund"), (2, None, "assets, and also a net"), (3, "x", "internet assets"), (4, None, None)], "id long, name string, text string")
    assert [(r.id, r.score) for r in lookup.search(texts, "net assets").collect()] == [(1, 11), (2, 2)]


def test_projection_keeps_childless_parents(spark, graph):
    found = projection.project(graph, "Step", (projection.Follow("reads", "reads"),)).orderBy("id").collect()
    assert [(r.id, [x.id for x in r.reads]) for r in found] == [("a", ["c"]), ("e", [])]


def test_projection_filters_sorts_and_takes_the_first(graph):
    follow = projection.Follow
    reads = lambda **more: [[(x.id, x.format) for x in r.reads] for r in projection.project(graph, "OcrStep", (follow("reads", "reads", attrs=("format",), **more),)).collect()]
    assert reads() == [[("c", "json"), ("d", None)]]
    assert reads(sort=("format",)) == [[("d", None), ("c", "json")]]
    assert reads(where=(("format", "=", "json"),)) == [[("c", "json")]]
    assert reads(where=(("format", "!=", "json"),)) == [[("d", None)]]
    assert reads(where=(("format", "=", "none"),)) == [[]]
    found = projection.project(graph, "Step", (follow("reads", "reads", first=True), follow("none", "none", optional=True)), attrs=("kind",)).orderBy("id").collect()
    assert [(r.id, r.kind, r.reads and r.reads.id) for r in found] == [("a", "x", "c"), ("e", None, None)] and "none" not in found[0]


def test_prefixes_mentions_and_ranges(spark):
    names = spark.createDataFrame([("a.b.c",), ("a.bb",), ("q",)], "name string")
    known = spark.createDataFrame([("a",), ("a.b",), ("a.bb.c",)], "prefix string")
    assert rows(atlas.longest_prefix(names, known), "name", "prefix") == [("a.b.c", "a.b"), ("a.bb", "a")]
    texts = spark.createDataFrame([(1, "see [Q1, Q4-6] and Q4"), (2, None)], "id int, text string")
    assert rows(atlas.ranges(texts, "Q"), "id", "cited") == [(1, "Q1"), (1, "Q4"), (1, "Q5"), (1, "Q6")]
    assert rows(atlas.mentions(texts, r"(\[)"), "id", "found") == [(1, "[")]
