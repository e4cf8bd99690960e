"""A digest of a table's rows that doesn't depend on their order or layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a row's hash that one sum takes: sums of 60-bit numbers fit a decimal for 10^20 rows.
DIGITS, SUMS = 15, 4


def table_digest(df: DataFrame) -> DataFrame:
    """One row: n and digest (64 hexadecimal digits) of all rows as a multiset, columns in order of their names.

    Rows' hashes are added up, so the work is one partial aggregation; nulls, empty strings and repeated rows count.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    pieces = [F.conv(F.substring("h", 1 + k * DIGITS, DIGITS), 16, 10).cast("decimal(20,0)") for k in range(SUMS)]
    sums: list[Column] = [F.coalesce(F.sum(p), F.lit(0).cast("decimal(38,0)")).alias(f"s{k}") for k, p in enumerate(pieces)]
    found = df.select(row.alias("h")).agg(F.count("*").alias("n"), *sums)
    return found.select("n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(SUMS)]), 256).alias("digest"))


def digest_of(df: DataFrame) -> str:
    return table_digest(df).first().digest
