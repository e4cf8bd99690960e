"""The stages of corpus_pipeline.py: each takes (spark, docs, sf_dir), with docs as its predecessor left them.

All but the last return the columns of docs, whatever further columns there are: names that a stage needs for itself are
chosen so that they clash with none.  An empty docs gives no rows at every stage.  Rows are told apart by their place in
docs' files, so null and repeated ids and equal rows lose nothing.  A text of any length is taken whole; a null text has
no language and goes at the first stage, and is empty for the others.  Texts go to the maps in small batches, for which the session's
bound of bytes in a batch is lowered.
"""

from __future__ import annotations

import uuid
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import fingerprint
from . import decontamination, langid, near_copies, packing, secrets, simhash
from .common import cut_lineage, fresh, numbered, own, shared_folder, small_batches, table, without
from .queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises; it learns from the rows with a language that aren't held out.

    Null texts and texts without a letter have no language and go.
    """
    small_batches(spark)
    held_out = F.coalesce(langid.remainder(own(docs, "doc_id")) == 2, F.lit(False))
    names = fresh(docs, "lang_pred", "score", "rejected")
    found = langid.identify(docs, langid.train(docs, held_out), names=names)
    return found.where(~own(found, names[2])).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the row with the smallest doc_id.

    Rows without a doc_id come after all others, and of rows with one doc_id the first in the files comes first.  Rows that share
    a doc_id but are no copies of each other all stay.
    """
    small_batches(spark)
    rows, names = numbered(docs)
    found = cut_lineage(near_copies.groups(rows, names))
    kept = found.groupBy("group").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "file", "row")).alias("x")).select("x.file", "x.row")
    gone = found.join(kept, ["file", "row"], "left_anti").select("file", "row").toDF(*names)
    return without(rows, gone, names).drop(*names)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    rows, names = numbered(docs)
    found = decontamination.contaminated(rows, names, table(spark, sf_dir, "benchmark"))
    return without(rows, found.select(F.col("file").alias(names[0]), F.col("row").alias(names[1])), names).drop(*names)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced; n_chars follows the text."""
    small_batches(spark)
    clean = secrets.redact(docs, secrets.train())
    if "n_chars" in docs.columns:
        n_chars = F.when(F.contains("text", F.lit(secrets.REDACTED)), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        clean = clean.select(*[n_chars.alias(c) if c == "n_chars" else own(clean, c) for c in clean.columns])
    return clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences: one row for each piece, with its token ids' place."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", packed),
]


def _inputs(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the input files' places, times and lengths and of the stages' parameters."""
    files = fingerprint(spark, [f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet"]).select(F.concat_ws("|", "path", "changed", "length").alias("f")).collect()  # a row for each file
    fixed = [(m.__name__, k, repr(v)) for m in (langid, near_copies, simhash, decontamination, secrets, packing) for k, v in sorted(vars(m).items()) if k.isupper() and isinstance(v, (int, float, str, tuple))]
    return sha1(repr((sorted(r.f for r in files), fixed, [name for name, _ in STAGES])).encode()).hexdigest()


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Every stage over documents; each stage's rows are written as Parquet and read again.

    With a folder of its own a run that was broken off goes on after the last stage that it finished.  What was finished for other
    files or other parameters stands in another subfolder and isn't used.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{folder}/{_inputs(spark, sf_dir)}" if folder else f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        if not _finished(spark, f"{folder}/{name}"):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a stage's folder holds the mark that Spark leaves when all of its files are written."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
