"""Shards along a Hilbert curve over several metadata dimensions.

Every document's metadata is quantised to 2^BITS steps in each dimension, the steps give its index on the
Hilbert curve, and runs of the curve's order are cut into shards with row counts at most one apart.  As the
curve never jumps, a shard covers a compact box in all dimensions at once, so a filter on any of them can skip
files by their minima and maxima.

Dimensions: language and source (equal values fall together), size in bytes (logarithmic), and id (linear
between its extremes).  Only ids, sizes and checksums are sorted, not texts.  The order is total, so a hot
source or a third of equal rows spreads over several range partitions; ranks come from the counts of the
sorted partitions, one number for each.

Defined results: a null text has size 8 and the checksum of the empty string; null metadata quantises to step 0; a null
doc_id stays null and sorts first within its curve cell; repeated rows get slots of their own (ties go by their
place in the input); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh

#: Bits of each dimension; DIMENSIONS * BITS must stay below 64.
BITS = 8


def hilbert_index(steps: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of steps (unsigned, below 2^bits, one column a dimension).

    The steps are turned into the curve's transposed form from the highest bit down: where a dimension's bit
    is set the lower bits of the first dimension are inverted, else they are exchanged with it; a Gray code
    over the dimensions and interleaving of the bits give the index.
    """
    x = steps.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for d in range(len(x)):
            is_set = (x[d] & bit) != 0
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(is_set, low, swap)
            x[d] ^= swap
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one != 0, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= flip
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            out = (out << one) | ((row >> np.uint64(b)) & one)
    return out.view(np.int64)


def by_value(column: Column) -> Column:
    """A step for a dimension without useful order: equal values fall together."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % (1 << BITS), F.lit(0))


def by_size(column: Column) -> Column:
    """A step on a logarithmic scale."""
    return F.least(F.floor(F.log2(F.coalesce(column, F.lit(0)) + 1.0) * 8), F.lit((1 << BITS) - 1))


def linear(column: Column, low: int | None, high: int | None) -> Column:
    """A step between the extremes of a numeric dimension."""
    if low is None:
        return F.lit(0).cast("long")
    share = (column.cast("double") - float(low)) / max(float(high) - float(low), 1.0)
    return F.coalesce(F.least(F.floor(share * (1 << BITS)), F.lit((1 << BITS) - 1)), F.lit(0).cast("long"))


def shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard and slot of every row: runs of the curve with counts at most one apart."""
    return placements(docs, F.monotonically_increasing_id(), n_shards, id_col, text_col, lang_col, source_col).drop("place")


def placements(docs: DataFrame, place: Column, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The columns of shards and the row's place, a long that is its own for every row of docs."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        by_value(F.col(lang_col)).alias("d0"),
        by_value(F.col(source_col)).alias("d1"),
        place.alias("place"),
    )
    rows = cut_lineage(rows)  # one pass over the texts
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    rows = rows.withColumn("d2", by_size(F.col("size"))).withColumn("d3", linear(F.col("doc_id"), low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = np.stack([batch.column(f"d{d}").to_numpy() for d in range(4)], 1).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(hilbert_index(steps, BITS))], [*kept, "hilbert"])

    kept = ["doc_id", "size", "text_crc32", "place"]
    curve = rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, place long, hilbert long")
    key = ["hilbert", "doc_id", "text_crc32", "size", "place"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(curve.repartitionByRange(parts, *key).sortWithinPartitions(*key))
    placed = ordered.withColumn("mark", F.monotonically_increasing_id())
    # partition number and place in the partition; one count a partition comes to the driver
    part, within = F.shiftright("mark", 33), F.col("mark").bitwiseAND((1 << 33) - 1)
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    numbers = sorted(sizes)
    n = sum(sizes.values())
    before = dict(zip(numbers, accumulate([0, *(sizes[p] for p in numbers)]), strict=False))
    starts = [before.get(p, 0) for p in range(max(numbers, default=0) + 1)]  # an array indexed by the partition's number
    rank = (F.array(*[F.lit(x).cast("long") for x in starts])[part.cast("int")] + within).cast("long")
    shard = F.expr(f"rank * {n_shards} div {max(n, 1)}")
    return (
        placed.withColumn("rank", rank)
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.expr(f"rank - (cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards}"))
        .select("doc_id", "size", "text_crc32", "hilbert", "shard", "slot", "place")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, **columns: str) -> None:
    """Write every row of docs once, one folder a shard, in the curve's order within it.

    Rows are numbered and kept in the shared folder first, so that a row's number is the same in both passes.  The columns shard and slot are
    added, with underscores before their names where docs has such columns itself.
    """
    place, shard, slot = fresh(docs, "place", "shard", "slot")
    rows = cut_lineage(docs.withColumn(place, F.monotonically_increasing_id()))
    placed = placements(rows, F.col(place), n_shards, **columns).select(F.col("place").alias(place), F.col("shard").alias(shard), F.col("slot").alias(slot))
    joined = rows.join(placed, place).drop(place)
    joined.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
