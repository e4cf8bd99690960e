"""The pipeline's stages on planted cases, and whole."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from atlasweave.llm import stages
from atlasweave.llm.secrets import REDACTED

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the of and that this with from there where when which would could house water river stone paper".split()
GERMAN = "der die das und nicht auch eine über schön haus wasser fluss stein größe straße zeit".split()
KEY = "9f8c1b2a7d6e5f4a3b2c1d0e9f8a7b6c5d4e3f2a"


def planted(item):
    rng = random.Random(0)
    prose = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(ENGLISH if i % 2 else GERMAN, rng.randrange(60, 200)), "en" if i % 2 else "de") for i in range(80)]
    rows += [(100, rows[3][1], "en"), (101, rows[5][1].upper(), "en"), (100, rows[3][1], "en"), (102, f"{prose(ENGLISH, 50)} {item} {prose(ENGLISH, 50)}", "en"), (103, f'{prose(ENGLISH, 60)} token = "{KEY}" {prose(ENGLISH, 30)}', "en")]
    rows += [(104, None, None), (105, "", "en"), (106, "123 456", None), (None, prose(ENGLISH, 80), None)]
    return [(i, t, lang, "src", len(t or "")) for i, t, lang in rows]


def test_stages_and_whole(spark, tmp_path):
    item = " ".join(f"question{k}" if k % 4 else "what" for k in range(40))
    spark.createDataFrame(planted(item), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = sorted(str(r.doc_id) for r in docs.select("doc_id").distinct().collect())
        assert name == "packing" or docs.columns == columns
    clean = {*map(str, range(80)), "None"}
    assert set(ids["language_id"]) == clean | {"100", "101", "102", "103"}
    assert set(ids["simhash_dedup"]) == clean | {"102", "103"}
    assert set(ids["decontamination"]) == clean | {"103"}
    assert set(ids["secret_scan"]) == set(ids["packing"]) == set(ids["decontamination"])
    text, n_chars = spark.read.parquet(str(tmp_path / "secret_scan")).where("doc_id = 103").select("text", "n_chars").first()
    assert KEY not in text and REDACTED in text and n_chars == len(text)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).first()[0] == docs.agg(F.sum("length")).first()[0]


def test_stages_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in stages.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_rows_that_share_an_id_all_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (1, "quite another text with own words", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (3, "third text of its own kind here", "en", "s", 1)], SCHEMA)
    assert sorted(r.doc_id for r in stages.near_duplicates(spark, docs, "").collect()) == [1, 1, 3]


def with_similarity(base, share, rng, name):
    """The words of a text whose five-word shingles have about the given similarity with those of base."""
    words, k = list(base), 0
    own = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    while len(own(base) & own(words)) / len(own(base) | own(words)) > share + 0.02:
        words[rng.randrange(len(words))], k = f"{name}{k}", k + 1
    return words, len(own(base) & own(words)) / len(own(base) | own(words))


def test_near_copies_from_similarity_0_8(spark):
    rng, rows, drop = random.Random(3), [], set()
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(250, 500))]
        rows.append((10 * g, " ".join(base)))
        for k, share in enumerate((0.6, 0.8, 0.87, 0.95)):
            words, got = with_similarity(base, share, rng, f"n{g}x{k}x")
            rows.append((10 * g + k + 1, " ".join(words)))
            if got >= 0.8:
                drop.add(10 * g + k + 1)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    kept = {r.doc_id for r in stages.near_duplicates(spark, docs, "").collect()}
    assert len(drop) > 170 and not drop & kept - set(sorted(drop & kept)[:1])  # candidates miss about one pair of 200 at 0.8
    assert {i for i, _ in rows} - drop <= kept


def test_similar_sets_are_linked_as_by_brute_force(monkeypatch):
    import numpy as np
    from atlasweave.llm import near_copies

    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 63, 40, dtype=np.uint64) for _ in range(5)]
    sets = [np.unique(np.concatenate([b[rng.random(40) < 0.93], rng.integers(0, 1 << 63, 2, dtype=np.uint64)])) for b in base for _ in range(12)] + [np.zeros(0, np.uint64)] * 2
    near = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and len(a := set(sets[i].tolist())) and 10 * len(a & (b := set(sets[j].tolist()))) >= 8 * len(a | b)}
    links = list(zip(*near_copies.similar_links(sets), strict=True))
    assert set(links) <= near

    def classes(pairs):
        label = list(range(len(sets)))
        for i, j in list(pairs) * len(sets):
            label[i] = label[j] = min(label[i], label[j])
        return label

    assert classes(links) == classes(near)


def test_copies_without_an_id_keep_one_and_unique_texts_stay(spark):
    a, b, c = ("first text of its own kind and words", "second text that stands here for itself", "third text with quite other words in it")
    docs = spark.createDataFrame([(None, a, "en", "s", 1), (None, a, "de", "s", 1), (None, a.upper(), "en", "s", 1), (None, b, "en", "s", 1), (1, b, "en", "s", 1), (2, b, "en", "s", 1), (2, c, "en", "s", 1)], SCHEMA)
    kept = stages.near_duplicates(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == [("1", b), ("2", c), ("None", a)]


CLASHES = ["n", "copy", "row", "file", "doc", "score", "lang_pred", "rejected", "shard", "slot", "key", "group", "body", "w", "bits", "__key", "text0", "x.y"]


def test_clashing_columns_nulls_and_repeated_rows_at_every_stage(spark, tmp_path):
    prose = lambda k, words=ENGLISH: " ".join(random.Random(k).choice(words) for _ in range(80))
    item = "name three rivers of the country and tell how long each of them is in miles"
    texts = [(1, prose(1)), (1, prose(2)), (1, prose(1)), (None, prose(3)), (None, prose(3)), (2, prose(4, GERMAN)), (3, f"{prose(5)} {item}"), (4, f'{prose(6)} token = "{KEY}"'), (5, None), (6, ""), (7, prose(7) * 200)]
    rows = [(i, t, "de" if i == 2 else "en", "s", len(t or ""), *[f"{c}{k}" for c in CLASHES]) for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in CLASHES)).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = lambda df: sorted(df.select("n", "`x.y`", "rejected", "score", "doc", "shard").collect())
    kept = lambda *ks: sorted((f"n{k}", f"x.y{k}", f"rejected{k}", f"score{k}", f"doc{k}", f"shard{k}") for k in ks)
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in stages.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        assert docs.columns == before.columns
        left[name] = own(docs)
    assert left["language_id"] == kept(*range(8), 10)
    assert len(left["simhash_dedup"]) == 7 and {r[0] for r in left["simhash_dedup"]} >= {"n1", "n5", "n6", "n7", "n10"}
    assert len(left["decontamination"]) == 6 and left["secret_scan"] == left["decontamination"]
    assert stages.packed(spark, docs, "").agg(F.countDistinct("doc_id")).first()[0] == 4


def test_a_run_goes_on_after_the_last_finished_stage(spark, tmp_path):
    spark.createDataFrame(planted("x y z"), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    first = stages.run(spark, str(tmp_path), str(tmp_path / "run")).count()
    (own,) = (tmp_path / "run").iterdir()
    made = (own / "simhash_dedup" / "_SUCCESS").stat().st_mtime_ns
    (own / "packing" / "_SUCCESS").unlink()
    assert stages.run(spark, str(tmp_path), str(tmp_path / "run")).count() == first
    assert (own / "simhash_dedup" / "_SUCCESS").stat().st_mtime_ns == made
    # other documents under the same name: nothing of the old run is used
    spark.createDataFrame(planted("x y z")[:3], SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    again = stages.run(spark, str(tmp_path), str(tmp_path / "run"))
    assert {r.doc_id for r in again.collect()} <= {r[0] for r in planted("x y z")[:3]} and len(list((tmp_path / "run").iterdir())) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_are_linked_as_by_brute_force(spark, monkeypatch, seed):
    """Groups of many blocks with several kinds of texts in them, and texts that bridge two kinds."""
    from atlasweave.llm import near_copies

    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng = random.Random(seed)
    rows = []
    for root in range(3):
        bases = [[f"r{root}k{k}w{i}" for i in range(60)] for k in range(3)]
        bases[1] = bases[0][:52] + bases[1][52:]  # like the first, but not enough by itself
        for n in range(70):
            words = list(bases[0 if n < 55 else 1 + n % 2])
            words[rng.randrange(60)] = f"x{n}" if n % 4 else words[0]
            rows.append((root, " ".join(words)))
        rows.append((root, " ".join(bases[0][:56] + bases[1][56:])))
    rows.append((9, "a group of one text"))
    members = spark.createDataFrame([(r, i, t) for i, (r, t) in enumerate(rows)], "root long, body long, text string").repartition(4)
    found = [(r.a, r.b) for r in near_copies.verified(members).collect()]
    sets = [set(near_copies.shingles(near_copies.words_of(t)).tolist()) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in near}

    def classes(pairs):
        label = list(range(len(rows)))

        def top(i):
            while label[i] != i:
                i = label[i]
            return i

        for i, j in pairs:
            label[max(top(i), top(j))] = min(top(i), top(j))
        return [top(i) for i in range(len(rows))]

    assert classes(found) == classes(near) and len(set(classes(near))) > 4


def test_components_in_one_task_or_in_rounds(spark, monkeypatch):
    from atlasweave.llm import near_copies

    rng = random.Random(6)
    pairs = [(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    one = {tuple(r) for r in near_copies.components(links).collect()}
    monkeypatch.setattr(near_copies, "LINKS", 10)
    assert {tuple(r) for r in near_copies.components(links).collect()} == one
    root = {n: n for p in pairs for n in p}
    for _ in range(300):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert one == {(n, r) for n, r in root.items() if n != r}
    assert near_copies.components(links.limit(0)).collect() == []


def test_shards_are_written_with_clashing_columns(spark, tmp_path):
    from atlasweave.llm.sharding import write_shards

    names = ["shard", "slot", "place", "__place", "size", "hilbert"]
    docs = spark.createDataFrame([(i, f"text {i % 7}", "en", "s", *[f"{c}{i}" for c in names]) for i in range(50)], "doc_id long, text string, lang string, source string" + "".join(f", {c} string" for c in names)).repartition(3)
    write_shards(docs, str(tmp_path / "out"), n_shards=5)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, found.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert {r["_shard"]: r["count"] for r in found.groupBy("_shard").count().collect()} == {k: 10 for k in range(5)} and {r["_slot"] for r in found.collect()} == set(range(10))


def test_numbered_rows_keep_their_names(spark, tmp_path):
    from atlasweave.llm.common import numbered

    spark.range(1000).repartition(3).selectExpr("id", "id AS row").write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    for df in (scan, scan.where("id % 2 = 0"), scan.repartition(5), scan.unionByName(scan), scan.selectExpr("id", "explode(array(1, 2)) AS row")):
        rows, names = numbered(df)
        assert rows.select(*names).distinct().count() == df.count()
        one, two = ({r[:] for r in rows.select("id", "row", *names).collect()} for _ in range(2))
        assert one == two


def test_stages_hand_texts_to_maps_in_small_batches(spark):
    import pyarrow as pa
    from atlasweave.llm import common

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text", "'en' AS lang", "'s' AS source", "5000L AS n_chars").coalesce(1)

    def largest():
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes])}) for b in batches), "n long")
        return sizes.agg(F.max("n")).first()[0]

    try:
        for stage in (stages.language_id, stages.secret_scan, stages.packed):
            spark.conf.set(key, "64m")
            assert largest() > 14_000_000
            stage(spark, docs, "")
            assert largest() < common.BATCH_BYTES + 10_000
        spark.conf.set(key, "1m")
        common.small_batches(spark)
        assert largest() < (1 << 20) + 10_000
    finally:
        spark.conf.unset(key)
