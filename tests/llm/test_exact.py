"""Search, tokens, packing, sharding, near duplicates and decontamination against brute force."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from atlasweave.llm import decontamination, packing, queries, sharding, simhash, token_counts, topk

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "  \n"), (None, "the the ñ 日本 \U0001f600"), (None, None), (4, "x" * 50_000), (4, "x" * 50_000), (5, "word " * 9_000), (6, "Don't STOP\t\r\n <|endoftext|> we'll  see 12.5%"), (7, "a b c\x85d e\x0bf")]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])


# -- search -----------------------------------------------------------------------------------------------------------


def brute_top(rows, k, asks):
    usable = [(i, [int(np.floor(float(x) * 1024)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in {(i, tuple(v)) for i, v in usable if asks(i)}:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)}
    return out


@pytest.mark.parametrize("slice_rows", [8192, 16])
def test_top_k_is_exact(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(topk, "SLICE", slice_rows)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.2, 6)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # copies: ties by id
    rows += [(5000, None), (5010, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5020, [float("nan")] * 6), (5030, [float("inf")] * 6), (None, [1.0] * 6), (5040, [1.0, 2.0]), (5050, [])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5)
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(r) for r in got.collect()} == brute_top(as_float, 5, lambda i: i % 10 == 0) and got.count() == len(brute_top(as_float, 5, lambda i: i % 10 == 0))


def test_top_k_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    ask = lambda rows: topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0)
    assert ask([]).count() == 0 and ask([(100, [1.0])]).count() == 0
    assert [tuple(r) for r in ask([(100, [1.0]), (3, [2.0])]).collect()] == [(100, 1, 3, 2 * 1024 * 1024)]


# -- tokens and packing -----------------------------------------------------------------------------------------------


def varied_texts():
    rng = random.Random(8)
    alphabet = ["the ", "And", "'ll", "'S", "ß", "é", "É", "İ", " ", "  ", "\n", "\t", "\r", " ", "　", "12", "½", "²", ".", "-", "_", "日", "\U0001f600", "x" * 30, "\x00", "\x7f", "\xad", "<|endoftext|>", "<|startoftext|>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20))) for _ in range(1500)]


@pytest.mark.parametrize("table_size", [1 << 15, 3])
def test_token_counts_equal_the_library(spark, monkeypatch, table_size):
    monkeypatch.setattr(token_counts, "TABLE_SIZE", table_size)
    path = queries.vocabulary("word_bpe_49k.json")
    rows = ODD + [(100 + i, t) for i, t in enumerate(varied_texts())]
    got = token_counts.count_tokens(spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", n_tokens int"), path, limit=100)
    library = token_counts.load(path)
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), path, 1).count() == 0


def test_token_counts_of_texts_beyond_latin_1_use_the_table(monkeypatch):
    path = queries.vocabulary("word_bpe_49k.json")
    library, rng = token_counts.load(path), random.Random(6)
    words = ["“Hello”", "don’t", "naïve—yes", "日本語", "Σίσυφος", "e\u0301tude", "£12€", "WORLD", "<|ENDOFTEXT|>", "<|endoftext|>x", "a\u00a0b", "\u2028", "x\x1cy", "ﬁn", "İstanbul", "the", "\U0001f600!"]
    simple = token_counts._Lengths({"the": 1, "hello": 1, "world": 1, "don": 1}, library)
    every = token_counts._AnyLengths(simple, ["<|startoftext|>", "<|endoftext|>"])
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t "]) for _ in range(rng.randrange(1, 12)))
        assert sum(every[c] for c in token_counts.WHITE.split(text) if c) == len(library.encode(text, add_special_tokens=False).ids), text
    encoded = []
    every.clear()
    every.tokenize = lambda part: encoded.append(part) or simple.tokenize(part)
    assert every["“hello”"] == 5 and len(encoded) == 2  # the quotes; the word is in the table
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 1000)
    small = token_counts._Lengths({}, library)
    for k in range(200):
        assert small[f"word{k}"] == len(library.encode(f"word{k}", add_special_tokens=False).ids)
    assert len(small) < 12 and small["y" * 300] and "y" * 300 not in small


def test_tightest_window_and_best_fit_decreasing():
    rng = random.Random(1)
    tree, rooms = packing.CapacityTree(64), []
    for _ in range(3000):
        if rooms and rng.random() < 0.4:
            room = rooms.pop(rng.randrange(len(rooms)))
            tree.add(room, -1)
        else:
            rooms.append(rng.randrange(65))
            tree.add(rooms[-1], 1)
        need = rng.randrange(1, 65)
        assert tree.tightest(need) == min((r for r in rooms if r >= need), default=-1)
    lengths = np.array([rng.randrange(1, 65) for _ in range(500)])
    window, offset = packing.best_fit_decreasing(lengths, 64)
    open_rooms: list[int] = []  # by hand: longest first, the least room that fits
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [r for r in open_rooms if r >= n]
        if fits:
            open_rooms[open_rooms.index(min(fits))] -= n
        else:
            open_rooms.append(64 - n)
    assert window.max() + 1 == len(open_rooms)
    assert_gapless(zip(window.tolist(), offset.tolist(), lengths.tolist(), strict=True), 64)


def assert_gapless(pieces, capacity):
    by = defaultdict(list)
    for window, offset, length in pieces:
        by[window].append((offset, length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_round_trip(spark):
    path = queries.vocabulary("byte_bpe_50k.json")
    rows = ODD + [(100 + i, t * (1 + i % 40)) for i, t in enumerate(varied_texts()[:600])]
    got = packing.pack(spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", length int").repartition(3), path, capacity=256, with_ids=True).collect()
    library = token_counts.load(path)
    pieces = defaultdict(list)
    for r in got:
        assert 1 <= r.length <= 256 and len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    assert_gapless([(r.sequence_id, r.offset, r.length) for r in got], 256)
    texts = defaultdict(list)
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        texts[i, len(ids)].append(ids)
    assert set(texts) == set(pieces)
    for key, wanted in texts.items():
        flat = [x for _, ids in sorted(pieces[key], key=lambda p: p[0]) for x in ids]
        assert len(flat) == sum(map(len, wanted)) and (len(wanted) > 1 or flat == wanted[0])
    assert packing.pack(spark.createDataFrame([], DOCS), path).count() == 0


# -- sharding ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_visits_all_cells_by_unit_steps(dims, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
    order = np.argsort(at := sharding.hilbert_index(cells, bits))
    assert sorted(at) == list(range(1 << (bits * dims)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n", [0, 5, 24, 1001])
def test_shards(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(400) if rng.random() < 0.9 else None, rng.choice([None, "", "same text", "ñ" * rng.randrange(40)]), rng.choice(["en", None]), "hot" if rng.random() < 0.5 else f"s{rng.randrange(9)}", "clash") for _ in range(n)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string, source string, hilbert string").repartition(3)
    got = sharding.shards(docs).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(24))
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    in_order = [r.hilbert for s in range(24) for r in sorted(by[s], key=lambda r: r.slot)]
    assert in_order == sorted(in_order)


def test_shard_files_prune(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}") for i in range(200)], DOCS + ", lang string, source string")
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 5
    assert back.groupBy("source").agg(F.countDistinct("shard").alias("n")).agg(F.max("n")).first()[0] < 5


def test_shard_files_hold_every_row(spark, tmp_path):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i // 2}", "en", f"s{i % 3}") for i in range(200)] + [(None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, DOCS + ", lang string, source string").repartition(3)
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(str, rows)) == sorted(str((r.doc_id, r.text, r.lang, r.source)) for r in back)
    at = [(r.shard, r.slot) for r in back]
    assert len(set(at)) == len(rows) and sorted(sum(x == s for x, _ in at) for s in range(5)) == [40, 40, 41, 41, 41]


# -- near duplicates --------------------------------------------------------------------------------------------------


def brute_simhash(text, n=4):
    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def near_texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 300))] for _ in range(60)]
    out = []
    for b in base:
        for _ in range(rng.randrange(1, 5)):
            copy = list(b)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return out


@pytest.mark.parametrize("block, chunk", [(1 << 16, 1 << 21), (8, 20)])
def test_components_equal_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = ODD + [(100 + i, t) for i, t in enumerate(near_texts(block))]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", fp int")).collect()
    fps = [brute_simhash(t) for _, t in rows]
    roots = brute_components(fps)
    least: dict = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((str(i), f"{fp:016x}", str(least.get(r))) for (i, _), fp, r in zip(rows, fps, roots, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_links_of_dense_and_spread_fingerprints():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    dense = np.full(300, base[0])
    for i in range(300):
        for b in rng.choice(40, rng.integers(0, 5), replace=False):
            dense[i] ^= np.uint64(1) << np.uint64(b)
    fp = np.unique(np.concatenate([base, dense]))
    x, y = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4)
    want = dict(zip(*simhash.spanning_links(fp, x, y), strict=True))
    for chunk in (1 << 21, 50):
        simhash.CHUNK, before = chunk, simhash.CHUNK
        try:
            parts = [simhash.close_links(fp, fp, part, 4) for part in range(simhash.PARTS)]
        finally:
            simhash.CHUNK = before
        assert dict(zip(*simhash.spanning_links(fp, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])), strict=True)) == want


# -- decontamination --------------------------------------------------------------------------------------------------

ITEM = "In the spring Anna bought 12 kg of flour and Anna sold 5 kg of it before the market closed at 7 in the evening."


def contaminated(spark, docs, items=((1, ITEM),)):
    names = "w string, form int, file string, row int, text0 string, item int, bits int"
    docs = spark.createDataFrame([(*d, *["clash", 1, "x", 2, "y", 3, 4]) for d in docs], f"{DOCS}, {names}")
    return decontamination.decontaminate(docs, spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, w int"))


def caught(spark, docs, items):
    return {r.doc_id: r.item_ids for r in contaminated(spark, docs, items).collect() if r.contaminated}


def test_other_parameters_are_the_same_question(spark):
    other = ITEM.replace("Anna", "Bertha").replace("12", "940").replace("5 kg", "31 kg")
    mixed = other.replace("Bertha sold", "Carol sold")  # equal values of the item needn't stay equal
    swapped = "Anna 1 2 3 4 5 6 7 8"  # names and numbers alone are no template
    docs = [(1, f"Some words here. {ITEM} And more."), (2, other), (3, mixed), (4, ITEM.upper()), (8, ITEM.lower()), (9, ITEM.title()), (5, ITEM.split(" before")[0]), (6, "Quite other prose about 12 kg of flour and a market in spring."), (10, swapped)]
    assert caught(spark, docs, ((1, ITEM),)) == dict.fromkeys([1, 2, 3, 4, 8, 9], "1")


@pytest.mark.parametrize("small", [True, False])
def test_short_items_occur_whole(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(decontamination, "HOT_KEYS", 4)  # most windows are salted
    items = [(1, "What is 12 + 30?"), (2, "Compute 3 + 4 * 5 - 6"), (3, "3 red apples and 3 green pears lie in 4 boxes"), (4, "Name the capital of Peru")]
    docs = [(10, "So, what is 12 + 30 then?"), (11, "what is 13 + 30"), (12, "please COMPUTE 3 + 4*5 - 6 now"), (13, "Compute 3 + 4 * 5 - 7"), (14, "7 red apples and 9 green pears lie in 2 boxes"), (15, "3 red apples and 8 green pears lie in 4 boxes"),
            (16, "name the capital of peru"), (17, "NAME THE CAPITAL OF PERU"), (18, "Name the capital of Chile"), (19, "name the river of peru"), *((100 + i, "7 red apples and 9 green pears lie there") for i in range(30))]
    assert caught(spark, docs, items) == {10: "1", 12: "2", 14: "3", 15: "3", 16: "4", 17: "4", 18: "4"}


def test_recall_of_changed_items(spark):
    rng = random.Random(8)
    words = [a + b for a in "bo ka li mu ne pra sto ti ve zu".split() for b in "ran del mit kos".split()]
    names, units = ["Anna", "Bertha Klein", "Carl", "Mary Ann Lee", "Otto", "Zoe Hart"], ["kg", "km", "litres", "hours", "euros"]
    number = lambda: rng.choice([str(rng.randrange(2, 900)), f"{rng.randrange(1, 90)}.{rng.randrange(1, 99)}", f"{rng.randrange(1, 9)},{rng.randrange(100, 999)}"])

    def template():
        parts = []
        for _ in range(rng.randrange(2, 4)):  # sentences, of which some begin with a name
            inner = [rng.choice(words) for _ in range(rng.randrange(7, 14))]
            for slot in rng.sample(["{n}", "{n} {u}", "{name}"], rng.randrange(1, 3)):
                inner.insert(rng.randrange(1, len(inner)), slot)
            parts.append((rng.choice(["{name}", "What"]) + " " + " ".join(inner)))
        return ". ".join(parts) + "?"

    def filled(text):
        while "{" in text:
            text = text.replace("{name}", rng.choice(names), 1).replace("{n}", number(), 1).replace("{u}", rng.choice(units), 1)
        return text

    templates = [template() for _ in range(200)]
    items = [(i, filled(t)) for i, t in enumerate(templates)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, f"{prose(20)}. {filled(t)} {prose(20)}") for i, t in enumerate(templates)]
    clean = [(1000 + i, f"{filled(template())} {prose(60)}") for i in range(200)]
    got = caught(spark, docs + clean, items)
    assert not [i for i in got if i >= 1000]
    assert sum(got.get(i) == str(i) for i in range(200)) >= 0.9 * 200


def test_decontamination_odd_rows(spark):
    rows = [*ODD, (8, ITEM), (8, ITEM), (None, ITEM)]
    got = contaminated(spark, rows, [(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, "1 2 3 4 5 6 7"), (7, "?!"), (1, ITEM), (6, ITEM)]).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_items, r.item_ids) for r in got if r.contaminated) == [("8", 2, "1,6"), ("8", 2, "1,6"), ("None", 2, "1,6")]
    assert contaminated(spark, rows, []).where("contaminated").count() == 0
    assert contaminated(spark, []).count() == 0


def test_the_rule_equals_its_sql(spark, tmp_path):
    rng = random.Random(4)
    words = "Anna Bob Mary Ann the of 12 3.5 kg km 7 buys apples NASA Ünal straße 1,000 hours I a".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    mixed = lambda t: rng.choice([str, str.lower, str.upper, str.title])(t)
    docs = [(i, " ".join(mixed(rng.choice(items)[1]) + rng.choice([" ", ". ", "\n\t", ", "]) for _ in range(rng.randrange(1, 4)))) for i in range(120)] + [*ODD, (None, items[3][1])]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*items, (None, "the of the of the"), (3, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = queries.op2_decontamination(spark, str(tmp_path))
    assert got.where("contaminated").count() > 60
    want = duck.execute(f"SELECT doc_id, contaminated, n_items, item_ids FROM ({queries.oracle_sql()['op2_decontamination']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("doc_id", "contaminated", "n_items", "item_ids").collect())


def test_long_runs_are_linear(spark):
    docs = [(1, "X" * 300_000), (2, "Anna Bob " * 20_000), (3, "1,2" * 50_000), (4, "a " * 100_000 + ITEM), (5, " " * 200_000)]
    assert caught(spark, docs, [(1, ITEM), (2, "one two")]) == {4: "1"}


def test_windows_are_hashed_in_generated_code_and_equal_a_plain_loop(spark):
    texts = [ITEM, "one two", "", None, "12 kg Anna Bob sold", "x", " ".join(f"w{i % 7} {i}" for i in range(40))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row int, text string")
    for form, short in ((decontamination.NAMED, ()), (decontamination.PLAIN, ()), (decontamination.PLAIN, (1, 3))):
        found = decontamination.windows(rows, F.col("text"), form, short)
        # only a token's own code may be a function of an array's elements; those are interpreted
        assert found._jdf.queryExecution().executedPlan().toString().count("lambdafunction(") <= 1
        lines = {r.row: r.x.split("\n") if r.x else [] for r in rows.select("row", decontamination.marked(decontamination.lines_of(F.col("text"), form == decontamination.NAMED)).alias("x")).collect()}
        kinds = [(form, 5), *((decontamination.SHORT, n) for n in short)]
        want = [(row, f, at, x[at : at + n]) for row, x in lines.items() for f, n in kinds for at in range(len(x) - n + 1)]
        assert sorted((r.row, r.form, r.at, r.window) for r in found.collect()) == sorted(want)
        assert found.where("w IS NULL").count() == 0


def test_common_windows_do_not_pair_all(spark):
    intro = "please answer the following question with one single word only and give no reasons"
    items = [(i, f"{intro} {' '.join(f'w{i}x{k}' for k in range(30))}") for i in range(30)]
    docs = [(100 + i, f"{intro} {' '.join(f'v{i}x{k}' for k in range(30))}") for i in range(30)] + [(7, items[7][1])]
    assert [(r.doc_id, r.item_ids) for r in contaminated(spark, docs, items).where("contaminated").collect()] == [(7, "7")]


def test_words_with_marks_share_the_ids_of_their_words(monkeypatch):
    import random
    import re

    from atlasweave.llm import common, id_files, packing
    from atlasweave.llm.queries import vocabulary
    from atlasweave.llm.token_counts import load

    path, other = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
    ids, pieces = id_files._Ids(path), packing._Ids(load(other))
    assert ids.document("stone, stone.") == ids.library("stone, stone.") and "stone" in ids.simple
    split = []
    monkeypatch.setattr(pieces, "split", lambda text, whole=pieces.split: split.append(text) or whole(text))
    assert pieces.document("a stone, stone.") == struct_of(other, "a stone, stone.") and split == ["a"]  # the first chunk alone
    rng, simple = random.Random(4), [chr(c) for c in range(0x20, 0x100) if not 0x7F <= c <= 0xA0]
    for _ in range(3000):
        text = "".join(rng.choice(simple + [" "] * 30 + ["\n", "'"] * 6 + list("abcdefstre") * 6) for _ in range(rng.randrange(1, 40)))
        assert not re.search(common.NOT_SIMPLE, text)
        assert ids.document(text) == ids.library(text) and pieces.document(text) == struct_of(other, text)


def struct_of(path, text):
    from array import array

    from atlasweave.llm.token_counts import load

    return array("I", load(path).encode(text, add_special_tokens=False).ids).tobytes()
