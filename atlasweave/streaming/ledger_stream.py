"""Ledger changes as a stream: validated appends, and counts by window.  An extension; batches use the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KINDS = ("baseline", "added", "changed", "removed")


def append_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of ledger changes to Parquet, rows that break a rule of their own to `rejected`; each batch exactly once.

    A batch's folder is overwritten when it is tried again, so a failure between the two writes leaves no duplicates.
    """

    def write(batch: DataFrame, number: int) -> None:
        fine = F.col("scope").isNotNull() & F.col("fact").isNotNull() & (F.col("revision") >= 1) & F.col("at").isNotNull() & F.col("kind").isin(*KINDS)
        marked = batch.withColumn("fine", F.coalesce(fine, F.lit(False))).persist()
        marked.where("fine").drop("fine").write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        marked.where("NOT fine").drop("fine").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        marked.unpersist()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_rates(changes: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Changes by window and kind, final once the watermark passes."""
    return changes.withWatermark("at", late).groupBy(F.window("at", window), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
