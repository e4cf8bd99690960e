"""Numbers, values before and running maxima by blocks against plain loops."""

import random

from pyspark.sql import functions as F

from atlasweave.operators import ledger
from atlasweave.operators.running import dealt, in_order

ROWS = "k string, j int, at int, v int, _n string"


def drawn(n: int, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    return [(None if x < 0.1 else "hot" if x < 0.6 else f"k{rng.randrange(40)}", rng.choice([None, 1, 2]), i, rng.choice([None, *range(50)]), "kept") for i, x in enumerate(rng.random() for _ in range(n))]


def looped(rows: list[tuple]) -> set[tuple]:
    out, seen = set(), {}
    for k, j, at, v, n in sorted(rows, key=lambda r: r[2]):
        values = seen.setdefault((k, j), [])
        out.add((k, j, at, v, n, len(values) + 1, values[-1] if values else None, max((x for x in values if x is not None), default=None)))
        values.append(v)
    return out


def test_blocks_equal_a_loop(spark):
    rows = drawn(3000)
    random.Random(1).shuffle(rows)
    for blocks in (1, 7, 64):
        found = in_order(spark.createDataFrame(rows, ROWS), ["k", "j"], ["at"], "place", {"was": "v"}, {"top": "v"}, blocks)
        assert {tuple(r) for r in found.collect()} == looped(rows), blocks


def test_a_group_over_every_block(spark):
    rows = [("hot", 1, i, (i * 7919) % 1000, "x") for i in range(2000)]
    found = in_order(spark.createDataFrame(rows, ROWS), ["k", "j"], ["at"], "place", {"was": "v"}, {"top": "v"}, 16)
    assert {tuple(r) for r in found.collect()} == looped(rows)


def test_a_hot_key_lies_in_many_blocks(spark):
    stored = dealt(spark.createDataFrame(drawn(8000), ROWS).drop("j"), ["k"], ["at"], "block", 16)
    most = stored.groupBy("k", "block").count().agg(F.max("count")).first()[0]
    assert stored.where("k = 'hot'").select("block").distinct().count() >= 7 and most < 1500, "half of all rows are one key's"


def test_nothing_and_one_row(spark):
    empty = spark.createDataFrame([], ROWS)
    assert in_order(empty, ["k"], ["at"], "place").isEmpty()
    assert [r.place for r in in_order(spark.createDataFrame([("a", 1, 1, 1, "")], ROWS), ["k"], ["at"], "place").collect()] == [1]


def test_a_ledger_with_one_large_scope(spark):
    log = spark.range(0, 40000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 999).cast("string"))).alias("scope"), F.col("id").alias("revision"), F.timestamp_seconds("id").alias("at"), F.lit("f").alias("fact"), F.lit("changed").alias("kind"), F.lit(None).cast("string").alias("previous"), F.col("id").cast("string").alias("value"))
    found = ledger.integrity(log).where("problem = 'doesn''t start from the held value' AND scope = 'hot'")
    assert found.count() == 19999
