"""Patterns whose clauses come in any order."""

import pytest
from pyspark.sql import functions as F

from atlasweave.operators.patterns import Edge, Either, Maybe, Node, NotEdge, Value, Where, match
from atlasweave.sources.lift import EDGES, LITERALS, NODES, Graph


@pytest.fixture(scope="module")
def small(spark):
    nodes = [("a", "N", "a"), ("b", "N", "b"), ("c", "M", "c")]
    edges = [("a", "r", "c"), ("a", "q", "b")]
    values = [("a", "size", "5"), ("b", "size", "9"), ("c", "limit", "7")]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(values, LITERALS))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_absent_edges_and_conditions_may_come_first(small):
    assert rows(match(small, [NotEdge("v", "r", "*"), Node("v", "N")]), "v") == [("b",)]
    assert rows(match(small, [Where(F.col("s") > 6), Value("v", "size", "s"), Node("v", "N")]), "v") == [("b",)]
    assert rows(match(small, [Node("x", "N"), Value("y", "limit", "l"), Edge("x", "r", "y")]), "x", "l") == [("a", "7")]


def test_groups_see_what_is_bound_outside(small):
    found = match(small, [Node("v", "N"), Value("v", "size", "s"), Maybe((Edge("v", "q", "w"), Value("w", "size", "t"), Where(F.col("t") > F.col("s"))))])
    assert rows(found, "v", "w") == [("a", "b"), ("b", None)]
    found = match(small, [Node("v", "N"), Either("kind", {"without": (NotEdge("v", "r", "*"),), "with": (Edge("v", "r", "w"),)})])
    assert rows(found, "v", "kind", "w") == [("a", "with", "c"), ("b", "without", None)]
    found = match(small, [Node("v", "N"), Maybe((NotEdge("v", "r", "*"), Value("v", "size", "s")))])
    assert rows(found, "v", "s") == [("a", None), ("b", "9")]


@pytest.mark.parametrize("clauses", [[Node("v", "N"), Node("w", "M")], [NotEdge("v", "r", "*")], [NotEdge("x", "r", "*"), Node("v", "N")]])
def test_unconnected_clauses_are_errors(small, clauses):
    with pytest.raises(ValueError):
        match(small, clauses)


def test_union_branches_join_on_their_own_variables(spark):
    graph = Graph(
        spark.createDataFrame([("a", "N", "a"), ("b", "N", "b"), ("c", "M", "c")], "id string, type string, label string"),
        spark.createDataFrame([("a", "r", "c"), ("b", "s", "c"), ("b", "t", "b")], "src string, rel string, dst string"),
        spark.createDataFrame([], "subj string, pred string, value string"),
    )
    # the second branch shares nothing with v, so it would pair all of M with all of N
    with pytest.raises(ValueError, match="no variable connects"):
        match(graph, [Node("v", "N"), Either("t", {"x": (Edge("v", "r", "w"),), "y": (Node("w", "M"),)})])
    # whichever is bound first, each branch joins on what it binds
    both = match(graph, [Edge("v", "r|s", "w"), Either("t", {"x": (Edge("v", "t", "u"),), "y": (Node("w", "M"),)})])
    assert {(r.v, r.w, r.t, r.u) for r in both.collect()} == {("b", "c", "x", "b"), ("a", "c", "y", None), ("b", "c", "y", None)}
    with pytest.raises(ValueError, match="only some branches"):
        match(graph, [Edge("v", "r|s", "w"), Either("t", {"x": (Edge("v", "t", "u"),), "y": (Node("w", "M"),)}), Edge("u", "t", "v")])


def test_an_unconnected_optional_group_has_one_solution_at_most(spark):
    graph = Graph(
        spark.createDataFrame([("a", "N", "a"), ("b", "N", "b"), ("c", "M", "c"), ("d", "L", "d"), ("e", "L", "e")], "id string, type string, label string"),
        spark.createDataFrame([], "src string, rel string, dst string"),
        spark.createDataFrame([], "subj string, pred string, value string"),
    )
    assert {(r.v, r.w) for r in match(graph, [Node("v", "N"), Maybe((Node("w", "M"),))]).collect()} == {("a", "c"), ("b", "c")}
    with pytest.raises(ValueError, match="several solutions"):
        match(graph, [Node("v", "N"), Maybe((Node("w", "L"),))])
