"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts made only of these characters split alike under Python's ``re`` and the tokenizers' own splitter:
#: Latin-1 without control characters, with no white space beyond tab, line feed, carriage return and space.
SIMPLE_RANGE = range(0x20, 0x100)
NOT_SIMPLE = r"[^\t\n\r\x20-\x7e\xa1-\xff]"


def char_class(kind: str) -> str:
    """Body of a regular-expression class: the simple characters of one Unicode kind ('L' letters, 'N' numbers)."""
    return "".join(
        chr(c) for c in SIMPLE_RANGE if unicodedata.category(chr(c))[0] == kind and not 0x7F <= c <= 0xA0
    )


#: Simple characters that are neither letters nor numbers nor white space.
MARKS = "".join(chr(c) for c in SIMPLE_RANGE if c > 0x20 and not 0x7F <= c <= 0xA0 and unicodedata.category(chr(c))[0] not in "LN")


def byte_letters() -> dict[int, str]:
    """For str.translate: the letter that stands for each byte in byte-level vocabularies.

    Visible bytes of Latin-1 stand for themselves, the others follow from U+0100 in order.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(0x100) if b not in visible)
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; where none is set, an own one in local mode only (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there from now on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of the rows that a map over whole texts gets at once (Spark's own bound is 64 MB); a longer text is a batch of its own.
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to maps in batches of about BATCH_BYTES, unless its bound is smaller already.

    A batch is held by Spark and by its Python worker, on the way there and back, so a task with few large batches needs many times their bytes.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df (in any case) has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame, name: str) -> Column:
    """A column of df by its name, whatever characters it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def _is_scan(df: DataFrame) -> bool:
    """Whether df gives rows of files one for one: a scan below projections and filters."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with two long columns that name each of its rows, and their names; every evaluation gives a row the same ones.

    Rows of a scan are named by their file (a hash of its path) and their place in it, so nothing is copied; other rows
    are written to the shared folder first.
    """
    names = fresh(df, "file", "row")
    if _is_scan(df):
        place = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(place["file_path"]).alias(names[0]), place["row_index"].alias(names[1])), names
    kept = cut_lineage(df)
    return kept.select("*", F.lit(0).cast("long").alias(names[0]), F.monotonically_increasing_id().alias(names[1])), names


#: Rows that are sent to all executors at most (two longs each, or a key and a value); keys that can be hot at most.
BROADCAST_ROWS, HOT_KEYS = 1 << 20, 1 << 12


def sized(rows: DataFrame) -> DataFrame:
    """rows, marked for a broadcast if they are BROADCAST_ROWS at most."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def without(df: DataFrame, gone: DataFrame, names: list[str]) -> DataFrame:
    """Rows of df whose names aren't in gone: texts stay where they are if gone is small, else rows are dealt by their names."""
    return df.join(sized(gone.select(*names).distinct()), names, "left_anti")


def join_sized(rows: DataFrame, sized: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with sized on the key; sized has one row for each key, whose column n says how many rows have it.

    Keys of more than total / HOT_KEYS rows are HOT_KEYS at most, so they are broadcast and their rows stay where they
    are; all other keys are few rows each and are joined by a shuffle.
    """
    least = max(1, total // HOT_KEYS)
    hot, cold = F.broadcast(sized.where(F.col("n") > least).drop("n")), sized.where(F.col("n") <= least).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
