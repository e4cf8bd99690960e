"""Dual-tree clustering, ranked search and token-id files against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasweave.llm import dual_tree, id_files, ranked_search
from atlasweave.llm.queries import vocabulary
from compare import assert_same, connect


# -- clustering -------------------------------------------------------------------------------------------------------


def plain_lloyd(rows, k, rounds, dims):
    import hashlib

    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])) if _ is not None][:k]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        c = [[sum(x) // len(m) for x in zip(*m, strict=True)] if (m := [v for (_, v), o in zip(kept, own, strict=True) if o == j]) else c[j] for j in range(len(c))]
    found = [(i, near(v), far(v, c[near(v)])) for i, v in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def clustered(spark, rows, k=4, rounds=5, dims=3):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, wide string")
    return sorted((tuple(r) for r in dual_tree.members(dual_tree.cluster(df, k=k, rounds=rounds, dims=dims)).collect()), key=str)


def test_clusters_equal_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) + 5 * (i % 3)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 0.0, 0.0]), (203, [1.0, float("inf"), 0.0]), (204, [1.0]), (205, []), (None, [1.0, 2.0, 3.0]), (3, rows[3][1]), (3, [0.5, 0.5, 0.5])]
    rows += [(300 + i, [2.0, 2.0, 2.0]) for i in range(60)]  # a group of copies
    assert clustered(spark, rows) == plain_lloyd(rows, 4, 5, 3)


def test_few_equal_and_no_vectors(spark):
    same = [(i, [1.0, 1.0, 1.0]) for i in range(6)]
    assert clustered(spark, same) == plain_lloyd(same, 4, 5, 3)
    two = [(1, [0.0, 0.0, 0.0]), (2, [9.0, 9.0, 9.0])]
    assert clustered(spark, two) == plain_lloyd(two, 4, 5, 3)
    assert clustered(spark, []) == []
    assert dual_tree.members(dual_tree.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_small_integers_stay_exact(spark):
    rows = [(i, [float(2**30 + 4096 * i), -float(2**30), 1.0]) for i in range(9)]
    assert clustered(spark, rows, k=3) == plain_lloyd(rows, 3, 5, 3)
    huge = clustered(spark, [(1, [3e38, 0.0, 0.0]), (2, [-3e38, 0.0, 0.0]), (3, [3e38, 1.0, 0.0])], k=1)
    assert len(huge) == 3 and all(r[2] is None for r in huge)


def test_cover_tree_is_one():
    rng = np.random.default_rng(2)
    for spread in (0, 3, 900):
        v = ((rng.normal(size=(6, 8)) * 1000)[rng.integers(0, 6, 700)] + rng.normal(size=(700, 8)) * spread).astype(np.int64)
        centres, gaps, owner = dual_tree.farthest_first(v.astype(float), 40)
        for k in range(1, len(centres)):  # separation, and the order of the gaps
            assert np.sqrt(((v[centres[:k]] - v[centres[k]]) ** 2).sum(1)).min() >= gaps[k] * (1 - 1e-6)
        assert (np.diff(gaps[1:]) <= 1e-6 * max(gaps[1:], default=0)).all()
        tree, order = dual_tree.cover_tree(v)
        assert sorted(order.tolist()) == list(range(700))
        for node in range(len(tree.centre)):  # every vector of a node is within its radius; a node is within its parent
            inside = tree.vectors[tree.low[node] : tree.high[node]]
            assert np.sqrt(((inside - tree.vectors[tree.centre[node]]) ** 2).sum(1)).max() <= tree.radius[node] * (1 + 1e-9)
            assert (inside.sum(0) == tree.sums[node]).all()
            if tree.parent[node] >= 0:
                assert tree.low[tree.parent[node]] <= tree.low[node] and tree.high[node] <= tree.high[tree.parent[node]]


def test_separate_groups_are_added_whole():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(8, 16)) * 10_000
    v = (middles[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    tree, _ = dual_tree.cover_tree(v)
    found, _, pairs, exact = dual_tree.assign(tree, middles.astype(np.int64))
    assert exact == 0 and pairs < len(tree.centre)
    assert (found == ((tree.vectors[:, None] - middles.astype(np.int64)[None]) ** 2).sum(2).argmin(1)).all()


# -- ranked search ----------------------------------------------------------------------------------------------------


def plain_search(docs, items, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    held = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in set(items):
        hits = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(words(text)) if w in c)
            if s > 0:
                hits.append((-s, (d is not None, d or 0), d))
        out += [(item, r, h[2], -h[0]) for r, h in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, n int").repartition(3)
    q = spark.createDataFrame([(i, t, "y", 2) for i, t in items], "item_id long, text string, item string, score int")
    return sorted((tuple(r) for r in ranked_search.search(d, q, k).collect()), key=str)


def corpus():
    rng = np.random.default_rng(8)
    words = [f"w{int(x)}" for x in np.minimum(rng.zipf(1.4, 6000), 300)]
    docs = [(i, " ".join(words[40 * i : 40 * i + int(rng.integers(1, 40))])) for i in range(150)]
    docs += [(150 + i, docs[0][1]) for i in range(40)]  # copies: ties
    docs += [(500, None), (501, ""), (502, "-- ..."), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "W1 w1 ÄW1 äw1 été"), (503, "w1 w5 w9 " * 4000), (504, "w77_w78 w79-w80 w1\x7fw2")]
    items = [(1, "w1 w2 w77 w200"), (2, "W5 w9 w9, w1"), (3, "w1"), (4, None), (5, ""), (6, "zzz"), (1, "w3 w4"), (1, "w3 w4"), (8, "ÄW1 äw1"), (None, "w10 w11 w12 w13 w14 w15 w16 w1 w2 w3")]
    return docs, items


@pytest.mark.parametrize("k", [1, 5, 50])
def test_search_equals_a_plain_loop(spark, k):
    docs, items = corpus()
    assert searched(spark, docs, items, k) == plain_search(docs, items, k)


def test_search_in_blocks_and_of_empty_tables(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(ranked_search, "TERMS", 6)
    monkeypatch.setattr(ranked_search, "CELLS", 50)
    assert searched(spark, docs, items, 5) == plain_search(docs, items, 5)
    assert searched(spark, docs, [], 5) == [] and searched(spark, [], items, 5) == [] and searched(spark, [(1, None)], [(1, None)], 5) == []


def test_thresholds_prune_terms_and_pairs(spark):
    docs, _ = corpus()
    items = spark.createDataFrame([(1, "w290 w280 w250 w1 w2")], "item_id long, text string")
    df = spark.createDataFrame([(i, t + " w1 w2" + (" w250 w280" if i % 9 == 0 else "")) for i, t in docs[:150]], "doc_id long, text string")
    index, plan, _, found = ranked_search.prepared(df, ranked_search.item_terms(items), 5)
    essential, others = len(plan.essential[1]), len(plan.others[1])
    assert others >= 2 and essential + others <= 5 and plan.threshold[0] > 0
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(index.toPandas())
    rescored = sum(n for *_, n in ranked_search.candidates(batch, plan, found.docs, found.terms))
    assert 0 < rescored < 75  # a word of every document stays out of the candidates


def test_queries_equal_sql(spark, sf_dir):
    from atlasweave.llm import queries

    duck = connect(sf_dir)
    for name in ("op11_centroid_clustering", "op12_ranked_search"):
        assert_same(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


# -- files of ids -----------------------------------------------------------------------------------------------------


def test_blocks_give_back_any_ids():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        for top in (1, 2, 50_000, 2**32 - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            if n and top > 2:
                ids[rng.integers(0, n, max(1, n // 30))] = 2**32 - 1
            starts, blocks = id_files.encode(ids.astype(np.int64))
            assert len(starts) == -(-n // id_files.BLOCK) and (id_files.decode(starts, blocks) == ids).all()
            if len(starts) > 1:  # one block alone
                assert (id_files.decode(starts[1:2], blocks) == ids[id_files.BLOCK : 2 * id_files.BLOCK]).all()


def test_outliers_dont_widen_a_block():
    ids = np.full(1024, 70_000)
    ids[::2] = 70_003
    ids[[5, 99]] = 2**31
    _, blocks = id_files.encode(ids)
    assert len(blocks) == id_files.HEAD.itemsize + 1024 * 2 // 8 + 2 * (2 + 4)


TEXTS = [
    (5, "The quick brown fox, it's 42 times"), (3, None), (9, ""), (3, "again 3"), (None, "no id"), (None, None), (4, "naïve café — “quotes” …  x y"), (8, "日本語 テキスト é ﬁ"), (7, "x" * 40_000), (6, "word " * 30_000),
    (10, "<|endoftext|> in <|startoftext|>text"), (11, "tabs\tand\r\nlines\n\n  "), (12, "\x00\x07 control ​"), (-4, "minus"), (3, "again 3"), (13, "I İ ſ ẞ straße"),
]


def test_files_equal_the_library(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(id_files, "SEGMENT", 3000)
    path, folder = vocabulary("word_bpe_49k.json"), str(tmp_path / "ids")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in TEXTS], "doc_id long, text string, part int, ids string").repartition(3)
    id_files.write_ids(docs, folder, path, end_id=2)
    found = sorted(id_files.read_documents(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in TEXTS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == want
    whole = [x for r in found for x in r.ids]
    for r in found:
        assert whole[r.start : r.start + r.n_tokens] == r.ids and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for start, n in ((0, 1), (1020, 10), (5000, 4000), (len(whole) - 3, 99)):
        got = [r.id for r in id_files.read_range(spark, folder, start, n).orderBy("place").collect()]
        assert got == whole[start : start + n]


def test_files_of_an_empty_table_and_of_the_generated_one(spark, tmp_path, sf_dir):
    path = vocabulary("word_bpe_49k.json")
    id_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), path, end_id=2)
    assert id_files.read_documents(spark, str(tmp_path / "none")).collect() == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    id_files.write_ids(docs, str(tmp_path / "all"), path, end_id=2)
    found = id_files.read_documents(spark, str(tmp_path / "all"))
    assert found.count() == docs.count()
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    assert found.withColumn("want", before).where("want <> start").count() == 0


def test_a_vocabulary_that_keeps_white_space_is_refused():
    with pytest.raises(ValueError):
        id_files.ids_of(vocabulary("byte_bpe_50k.json"))
