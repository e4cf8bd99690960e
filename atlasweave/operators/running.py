"""Numbers, values before and running maxima in order, for groups of any size.

A window by a key alone sorts a key's whole history in one task.  Here all rows are dealt to blocks by ranges of key and order, so that a
key with half of all rows lies in about half of the blocks; windows stay within a block, and what a block must know of the ones before it
(rows, last values, maxima) is carried over from summaries.  Only a key that goes over a block's end has any, so at most two summaries a block are
carried: they are broadcast, and their number doesn't grow with the rows.

Defined results: null keys are a group; null values count as values before and are no maximum; rows equal in key and order stand in one block, in
no particular order; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def dealt(rows: DataFrame, keys: list[str], order: list[str], block: str, blocks: int | None = None) -> DataFrame:
    """rows with the block they stand in, stored: blocks are ranges of keys and order, and ascend with them."""
    number = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(number, *keys, *order).withColumn(block, F.spark_partition_id()))


def _same(a: DataFrame, b: DataFrame, names: dict[str, str]) -> Column:
    return reduce(lambda x, y: x & y, [a[left].eqNullSafe(b[right]) for left, right in names.items()])


def in_order(rows: DataFrame, keys: list[str], order: list[str], place: str | None = None, before: dict[str, str] | None = None, highest: dict[str, str] | None = None, blocks: int | None = None) -> DataFrame:
    """rows with what their key's rows before them say, by ascending order.

    place names the row's number from 1; before={new: column} gives the column's value in the row before; highest={new: column} its maximum over
    all rows before.
    """
    before, highest, prefix = before or {}, highest or {}, "_"
    while any(c.startswith(prefix) for c in rows.columns):
        prefix += "_"
    block, local = f"{prefix}block", f"{prefix}place"
    stored = dealt(rows, keys, order, block, blocks)

    sizes = [F.count("*").alias(f"{prefix}n"), *[F.max_by(F.struct(c), F.struct(*order)).alias(f"{prefix}b{i}") for i, c in enumerate(before.values())], *[F.max(c).alias(f"{prefix}h{i}") for i, c in enumerate(highest.values())]]
    summary = stored.groupBy(*keys, block).agg(*sizes)
    whole = Window.partitionBy(*keys)
    ends = stored.groupBy(block).agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high")).select(F.col(block).alias("at"), F.explode(F.array("low", "high")).alias("key")).distinct()
    edges = summary.join(F.broadcast(ends), (F.col(block) == F.col("at")) & F.struct(*keys).eqNullSafe(F.col("key"))).drop("at", "key")
    past = whole.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *[F.col(k).alias(f"{prefix}k{i}") for i, k in enumerate(keys)], F.col(block).alias(f"{prefix}at"), F.sum(f"{prefix}n").over(past).alias(f"{prefix}n"),
        *[F.lag(f"{prefix}b{i}").over(whole.orderBy(block)).alias(f"{prefix}b{i}") for i in range(len(before))], *[F.max(f"{prefix}h{i}").over(past).alias(f"{prefix}h{i}") for i in range(len(highest))],
    ).where(F.col(f"{prefix}n").isNotNull())

    here = Window.partitionBy(*keys, block).orderBy(*order)
    above = here.rowsBetween(Window.unboundedPreceding, -1)
    counted = stored.select("*", F.row_number().over(here).alias(local), *[F.lag(c).over(here).alias(f"{prefix}lb{i}") for i, c in enumerate(before.values())], *[F.max(c).over(above).alias(f"{prefix}lh{i}") for i, c in enumerate(highest.values())])
    joined = counted.join(F.broadcast(carried), _same(counted, carried, {**{k: f"{prefix}k{i}" for i, k in enumerate(keys)}, block: f"{prefix}at"}), "left")
    added = [(F.col(local) + F.coalesce(f"{prefix}n", F.lit(0))).alias(place)] if place else []
    added += [F.when(F.col(local) == 1, F.col(f"{prefix}b{i}")[c]).otherwise(F.col(f"{prefix}lb{i}")).alias(new) for i, (new, c) in enumerate(before.items())]
    added += [F.greatest(f"{prefix}lh{i}", f"{prefix}h{i}").alias(new) for i, new in enumerate(highest)]
    return joined.select(*rows.columns, *added)
