"""Rules evaluated by what is new, against a plain fixpoint."""

import random

import pytest

from atlasweave.operators.patterns import Edge, Either, Node, NotEdge, Value, Where
from atlasweave.operators.recursion import CycleThroughNegation, Rule, evaluate, strata
from atlasweave.sources.lift import EDGES, LITERALS, NODES, Graph

REACH = [Rule("step", "reach", (Edge("src", "next", "dst"),)), Rule("further", "reach", (Edge("src", "reach", "m"), Edge("m", "reach", "dst")))]


def graph(spark, edges, nodes=()):
    return Graph(spark.createDataFrame(list(nodes), NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame([], LITERALS))


def pairs(df):
    rows = [(r.src, r.dst) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def closed(found):
    found = set(found)
    while more := {(a, d) for a, b in found for c, d in found if b == c} - found:
        found |= more
    return found


def test_closure_and_what_is_out_of_reach(spark):
    chance = random.Random(4)
    links = {(f"n{chance.randrange(14)}", f"n{chance.randrange(14)}") for _ in range(22)}
    names = sorted({x for e in links for x in e})
    g = graph(spark, [(a, "next", b) for a, b in links] + [("n0", "reach", "base")], [(n, "N", n) for n in names])
    apart = Rule("apart", "apart", (Edge("src", "reach", "m"), Edge("m", "next", "dst"), NotEdge("dst", "reach", "src")))
    found = evaluate(g, [apart, *REACH])
    want = closed(links | {("n0", "base")})
    assert pairs(found.edges_of("reach")) == want - {("n0", "base")}  # what the graph has isn't derived again
    assert pairs(found.edges_of("apart")) == {(a, d) for a, b in want for c, d in links if b == c and (d, a) not in want}


def test_rounds_follow_what_is_new(spark):
    chain = [(f"c{i:02d}", "next", f"c{i + 1:02d}") for i in range(16)]
    line = [Rule("step", "reach", (Edge("src", "next", "dst"),)), Rule("further", "reach", (Edge("src", "reach", "m"), Edge("m", "next", "dst")))]
    found = evaluate(graph(spark, chain), line)
    assert [n for _, n in found.rounds] == list(range(16, 0, -1))  # each round finds the pairs that are one step longer, none twice
    assert len(evaluate(graph(spark, chain), REACH).rounds) == 5  # two clauses that grow: lengths double


def test_strata_and_cycles(spark):
    odd = Rule("odd", "odd", (Node("src", "N"), Edge("src", "next", "dst"), NotEdge("src", "reach", "src")))
    assert [[r.id for r in s] for s in strata([odd, *REACH])] == [["step", "further"], ["odd"]]
    both = [Rule("a", "a", (Edge("src", "b", "dst"),)), Rule("b", "b", (Edge("src", "next", "dst"), NotEdge("src", "a", "dst")))]
    with pytest.raises(CycleThroughNegation):
        strata(both)
    with pytest.raises(CycleThroughNegation):
        strata([Rule("u", "u", (Edge("src", "next", "dst"), Either("t", {"x": (Edge("dst", "u", "z"),), "y": (Edge("dst", "next", "z"),)})))])


def test_two_relations_that_feed_each_other(spark):
    edges = [("a", "next", "b"), ("b", "next", "c"), ("c", "next", "d"), ("d", "next", "e")]
    rules = [Rule("e0", "even", (Edge("src", "next", "m"), Edge("m", "next", "dst"))), Rule("o", "odd", (Edge("src", "even", "m"), Edge("m", "next", "dst"))), Rule("e", "even", (Edge("src", "odd", "m"), Edge("m", "next", "dst")))]
    found = evaluate(graph(spark, edges), rules)
    assert pairs(found.edges_of("odd")) == {("a", "d"), ("b", "e")} and pairs(found.edges_of("even")) == {("a", "c"), ("b", "d"), ("c", "e"), ("a", "e")}
    assert pairs(found.edges_of("nothing")) == set()


def test_conditions_and_classes_in_bodies(spark):
    g = Graph(spark.createDataFrame([("a", "N", "a"), ("b", "M", "b"), ("c", "N", "c")], NODES), spark.createDataFrame([("a", "next", "b"), ("b", "next", "c")], EDGES), spark.createDataFrame([("a", "size", "5"), ("b", "size", "1")], LITERALS))
    from pyspark.sql import functions as F

    big = Rule("big", "big", (Edge("src", "next", "dst"), Value("src", "size", "s"), Where(F.col("s").cast("int") > 2)))
    assert pairs(evaluate(g, [big]).edges_of("big")) == {("a", "b")}
    assert pairs(evaluate(g, [Rule("n", "n", (Node("dst", "N"), Edge("src", "next", "dst")))]).edges_of("n")) == {("b", "c")}
