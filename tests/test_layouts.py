"""Published versions, the inverted index and the adjacency layout, against scans and plain loops."""

import time

import pytest
from pyspark.sql import functions as F

from atlasweave.functions.digest import digest_of
from atlasweave.operators import lookup, walk
from atlasweave.sources import adjacency, postings, versions
from atlasweave.sources.lift import EDGES, LITERALS, NODES, Graph, lift


def files_read(df) -> int:
    """How many files the scans below df's filters and projections have opened."""
    df.collect()
    plan, todo, n = df._jdf.queryExecution().executedPlan(), [], 0
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            n += p.metrics().apply("numFiles").value()
    return n


def same(a, b) -> None:
    assert sorted(map(tuple, a.select(sorted(a.columns)).collect()), key=str) == sorted(map(tuple, b.select(sorted(b.columns)).collect()), key=str)


# -- versions ---------------------------------------------------------------------------------------------------------


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v long")


def test_readers_see_whole_versions_only(spark, tmp_path):
    folder = str(tmp_path)
    assert versions.current(spark, folder) is None
    one = versions.publish(spark, folder, {"a": versions.Table(frame(spark, ("x", 1)), ("k",), ("v",)), "b": versions.Table(frame(spark, ("y", 2)))}, meta={"by": "me"})
    now = versions.current(spark, folder)
    assert now == one and now.meta == {"by": "me"} and now.read(spark, "a").collect() == [("x", 1)] and now.read(spark, "b").collect() == [("y", 2)]

    def die(version):
        raise KeyboardInterrupt  # between its tables and the pointer

    with pytest.raises(KeyboardInterrupt):
        versions.publish(spark, folder, {"a": versions.Table(frame(spark, ("z", 9)))}, base=one, check=die)
    assert versions.current(spark, folder) == one
    two = versions.publish(spark, folder, {"a": versions.Table(frame(spark, ("x", 3)))}, base=one)
    assert versions.current(spark, folder) == two and two.number == 2 and versions.current(spark, folder, 1) == one
    three = versions.publish(spark, folder, {"a": versions.Table(frame(spark, ("x", 4)))}, base=two)
    assert versions.remove_old(spark, folder, keep=2) == [1] and versions.current(spark, folder, 1) is None and versions.current(spark, folder) == three


def test_of_two_writers_one_is_refused(spark, tmp_path):
    folder = str(tmp_path)
    base = versions.publish(spark, folder, {"a": versions.Table(frame(spark, ("x", 1)))})
    first = versions.publish(spark, folder, {"a": versions.Table(frame(spark, ("x", 2)))}, base=base)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, folder, {"a": versions.Table(frame(spark, ("x", 3)))}, base=base)
    with pytest.raises(versions.Conflict):
        versions.publish(spark, folder, {"a": versions.Table(frame(spark, ("x", 3)))})
    # a pointer without content belongs to a writer at work, and after a while to one that died
    (tmp_path / "pointers" / "000000003").touch()
    assert versions.current(spark, folder) == first
    with pytest.raises(versions.Conflict):
        versions.publish(spark, folder, {"a": versions.Table(frame(spark, ("x", 3)))}, base=first)
    old = time.time() - 2 * versions.ABANDONED
    import os

    os.utime(tmp_path / "pointers" / "000000003", (old, old))
    later = versions.publish(spark, folder, {"a": versions.Table(frame(spark, ("x", 3)))}, base=first)
    assert later.number == 4 and versions.current(spark, folder) == later


def test_digest_depends_on_rows_alone(spark):
    rows = [("a", 1), ("b", 2), (None, 3), ("", 3), ("a", 1)]
    base = digest_of(frame(spark, *rows))
    assert digest_of(frame(spark, *reversed(rows)).repartition(5).select("v", "k")) == base
    for other in (rows[:-1], [*rows[:-1], ("a", 2)], [("a", 1), ("b", 2), ("", 3), ("", 3), ("a", 1)], [*rows, (None, None)]):
        assert digest_of(frame(spark, *other)) != base
    assert digest_of(frame(spark)) == digest_of(frame(spark).repartition(3)) != base
    assert digest_of(spark.createDataFrame([("x", None)], "a string, b string")) != digest_of(spark.createDataFrame([(None, "x")], "a string, b string"))


# -- names and words --------------------------------------------------------------------------------------------------

PEOPLE = [
    ("report/r1/field/nav", "Field", "Net_asset-value"), ("report/r2/field/nav", "Field", "NAV total"), ("report/r1", "ReportType", "Fund profile"), ("report/r1/meaning/1", "FieldMeaning", "Value of the fund"),
    ("part/7", "Part", "#13 bolt"), ("part/8", "Part", "été bolt-on"), ("part/9", "Part", "x"), ("part/10", "Part", "日本 bolt"), ("part/11", "Part", "a" * 90 + " tail"), ("part/12", "Part", None), ("nav", "Part", "blue net"),
]


@pytest.fixture(scope="module")
def named(spark, tmp_path_factory):
    edges = [("report/r1/field/nav", "hasMeaning", "report/r1/meaning/1")]
    values = [("report/r1/meaning/1", "definition", "What all holdings are worth, the net value"), ("report/r1", "purpose", "A profile of one fund")]
    graph = Graph(spark.createDataFrame(PEOPLE, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(values, LITERALS))
    found = postings.entries(graph, text_preds=["definition", "purpose"])
    return found, postings.publish(spark, str(tmp_path_factory.mktemp("index")), found, letters=2)


@pytest.mark.parametrize("asked", ["nav", "NAV", "net asset value", "net", "bolt", "#13", "été", "x", "日本", "value", "fund pro", "a" * 90, "a" * 70, "report/r1", "__net", "13", "tail", "nothing"])
def test_resolve_equals_a_scan(named, asked):
    found, index = named
    names = found.where("name IS NOT NULL").select("id", "type", "name")
    same(postings.resolve(index, asked, {"ReportType": 0, "Field": 1}), lookup.resolve(names, asked, {"ReportType": 0, "Field": 1}))


def test_meanings_lend_their_names_and_texts(named):
    _, index = named
    assert [r.id for r in postings.resolve(index, "value of the fund").collect()] == ["report/r1/field/nav", "report/r1/meaning/1"]
    hits = {r.id: r.score for r in postings.search(index, "net value").collect()}
    assert hits == {"report/r1/field/nav": 3 + 3 + 5, "report/r1/meaning/1": 1 + 3 + 5}
    assert [r.id for r in postings.search(index, "net value", types=["Field"]).collect()] == ["report/r1/field/nav"]
    assert postings.search(index, "net value", scope="r2").collect() == [] and postings.resolve(index, "nav", scope="r2").first().id == "report/r2/field/nav"
    assert postings.search(index, "a" * 70).first().id == "part/11" and postings.search(index, "a" * 91).collect() == []
    assert [r.id for r in postings.terms_hit(index, "profile", term_types=("ReportType",)).collect()] == ["report/r1"]
    with pytest.raises(ValueError):
        postings.search(index, "? !")


def test_search_equals_a_scan_and_reads_few_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), F.lit("document").alias("type"), F.lit(None).cast("string").alias("scope"), F.col("source").alias("name"), "text")
    index = postings.publish(spark, str(tmp_path), docs)
    plain = docs.select("id", "name", "text")
    for query in ("The and", "der", "la de que", "unfindable", "2024", "the the"):
        same(postings.search(index, query, 30).select("id", "score", "snippet"), lookup.search(plain, query, 30))
    wide = postings.publish(spark, str(tmp_path / "wide"), docs, letters=3)
    for query in ("The and", "de que", "un la"):
        same(postings.search(wide, query, 30), postings.search(index, query, 30))
    assert files_read(wide.postings(["the"])) == 1
    every = len(set(index.read("words").select(F.input_file_name()).distinct().collect()))
    assert files_read(index.postings(["the"])) <= 4 < every


def test_a_frequent_word_has_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(40_000).select(F.concat(F.lit("n/"), "id").alias("id"), F.lit("N").alias("type"), F.lit(None).cast("string").alias("scope"), F.lit("common").alias("name"), F.lit(None).cast("string").alias("text"))
    index = postings.publish(spark, str(tmp_path), rows)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.postings(["common"]).select(F.input_file_name()).distinct().count() > 1
    assert postings.resolve(index, "common").first().more == 39_990


# -- edges by node ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    graph = lift(spark, sf_dir)
    return graph, adjacency.publish(spark, str(tmp_path_factory.mktemp("links")), graph)


@pytest.mark.parametrize("start, depth, direction, rel", [("customer/1", 3, "both", None), ("nation/1", 2, "in", "inNation"), ("supplier/1", 2, "out", None), ("nobody/1", 2, "both", None)])
def test_stored_hops_equal_scans(spark, stored, start, depth, direction, rel):
    graph, links = stored
    starts = spark.createDataFrame([(start,)], "id string")
    same(adjacency.hops(links, starts, depth, direction, rel), walk.hops(graph, starts, depth, direction, rel))


def test_many_nodes_are_joined(spark, stored, monkeypatch):
    graph, links = stored
    monkeypatch.setattr(adjacency, "FEW", 2)
    starts = graph.nodes_of(["Nation"]).select("id")
    same(adjacency.hops(links, starts, 2, "in"), walk.hops(graph, starts, 2, "in"))


def test_cards_open_their_own_folders(spark, stored):
    graph, links = stored
    same(adjacency.entity_card(links, ["part/1", "customer/2"]), walk.entity_card(graph, spark.createDataFrame([("part/1",), ("customer/2",)], "id string")))
    every = links.version.read(spark, "links").select(F.input_file_name()).distinct().count()
    assert files_read(links.of("links", ["part/1"])) <= 2 < every


def test_degrees_count_ends_that_are_no_node_or_several(spark, tmp_path):
    nodes = [("a", "A", "x"), ("b", "B", "y"), ("b", "B", "z")]
    edges = [("a", "r", "b"), ("a", "r", "b"), ("a", "r", "c"), ("c", "s", "a"), ("b", "s", "b"), ("d", "r", "c")]
    graph = Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame([("a", "p", "1")], LITERALS))
    stored = adjacency.publish(spark, str(tmp_path / "links"), graph)
    ends = [(s, "out", d) for s, _, d in set(edges)] + [(d, "in", s) for s, _, d in set(edges)]
    many = {n: [x for x, _, _ in nodes].count(n) for n in "abcd"}
    want = {(n, k): (sum(max(1, many[o]) for a, b, o in ends if (a, b) == (n, k)), sum(many[o] for a, b, o in ends if (a, b) == (n, k))) for n, k, _ in ends}
    assert {(r.id, r.kind): (r.n, r.known) for r in adjacency.degrees(stored).collect()} == want
    same(adjacency.entity_card(stored, ["a", "b"]), walk.entity_card(Graph(graph.nodes, graph.edges.distinct(), graph.literals), spark.createDataFrame([("a",), ("b",)], "id string")))


def test_slices_hold_every_row_once_and_leave_no_shuffles(spark, sf_dir, stored, tmp_path):
    graph, whole = stored
    sliced = adjacency.publish(spark, str(tmp_path / "links"), graph, slices=3)
    for name in ("links", "nodes", "values"):
        same(sliced.version.read(spark, name), whole.version.read(spark, name))
    assert "other_label" not in sliced.version.read(spark, "links").columns
    plan = adjacency.tables(graph, 3)["links"]
    rows = plan.rows.where(plan.slices[1]).repartitionByRange(*plan.folders, *plan.order)
    text = plan.gathered(rows)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == text.count("Exchange rangepartitioning") == 1
    kept = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: sum(b.isShuffle() for b in (kept.getAllBlocks().apply(i) for i in range(kept.getAllBlocks().size())))
    before = held()
    adjacency.publish(spark, str(tmp_path / "again"), graph, slices=2)
    assert held() <= before


def test_index_slices_hold_every_row_once_and_texts_are_split_once(spark, sf_dir, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d/"), (F.col("doc_id") % 150).cast("string")).alias("id"), F.lit("document").alias("type"), F.col("lang").alias("scope"), F.col("source").alias("name"), "text")
    whole = postings.publish(spark, str(tmp_path / "whole"), docs)
    sliced = postings.publish(spark, str(tmp_path / "sliced"), docs, slices=3)
    for name in ("names", "words", "texts"):
        same(sliced.read(name), whole.read(name))
    assert whole.read("words").groupBy("word", "id", "type", "scope").count().where("count > 1").isEmpty() and whole.read("texts").count() == docs.count()
    assert not list((tmp_path / "sliced").glob("staged-*"))
    for name in ("names", "words"):  # one shuffle each, and none of the texts before it
        table = postings.tables(docs)[name]
        plan = table.gathered(table.rows.repartitionByRange(*table.folders, *table.order))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("Exchange rangepartitioning") == 1


def test_hops_over_slices_equal_scans(spark, sf_dir, tmp_path):
    graph = lift(spark, sf_dir)
    sliced = adjacency.publish(spark, str(tmp_path), graph, slices=2)
    starts = spark.createDataFrame([("supplier/1",)], "id string")
    same(adjacency.hops(sliced, starts, 2), walk.hops(graph, starts, 2))
