"""Layouts of the warehouse graph that registered queries read: written once a session and set of input files, to the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha1
from uuid import uuid4

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder, written
from ..sources import adjacency, postings, versions
from ..sources.lift import WAREHOUSE, lift

#: Folders of this session's layouts, by kind and by a digest of the input files' places, times and lengths.
_folders: dict[tuple[str, str, str], str] = {}


#: Bytes of input files for each slice that a layout is written in, and slices at most: each of them reads the tables again.
SLICE, SLICES = 512 << 20, 8


def _folder(spark: SparkSession, sf_dir: str, kind: str, names: list[str], write: Callable[[str, int], object]) -> str:
    rows = versions.fingerprint(spark, [f"{sf_dir}/{n}.parquet" for n in names]).select(F.concat_ws("|", "path", "changed", "length").alias("f"), "length").collect()  # a row for each file
    key = spark.sparkContext.applicationId, kind, sha1("\n".join(sorted(r.f for r in rows)).encode()).hexdigest()
    if key not in _folders:
        folder = f"{shared_folder(spark)}/{kind}-{uuid4().hex}"
        write(folder, min(SLICES, 1 + sum(r.length for r in rows) // SLICE))
        _folders[key] = folder
    return _folders[key]


def graph_links(spark: SparkSession, sf_dir: str) -> adjacency.Adjacency:
    """The warehouse graph by node."""
    names = sorted({s.table for s in WAREHOUSE})
    return adjacency.open_adjacency(spark, _folder(spark, sf_dir, "links", names, lambda folder, slices: adjacency.publish(spark, folder, lift(spark, sf_dir), slices=slices)))


def graph_names(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The names of the warehouse graph's nodes; a customer's nation is its scope."""
    names = sorted({s.table for s in WAREHOUSE})
    found = lambda: written(postings.entries(lift(spark, sf_dir), meaning=None, scope_pattern=r"^(region|nation)/"), "entries")
    return postings.open_index(spark, _folder(spark, sf_dir, "names", names, lambda folder, slices: postings.publish(spark, folder, found(), slices=slices)))


def document_words(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The words of documents and pages: a source is a document's name, an address a page's."""

    def found():
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        entry = lambda rows, type_, key, scope, name, text: rows.select(F.concat(F.lit(f"{type_}/"), F.col(key).cast("string")).alias("id"), F.lit(type_).alias("type"), F.col(scope).cast("string").alias("scope"), F.col(name).alias("name"), F.col(text).alias("text"))
        return entry(read("documents"), "document", "doc_id", "lang", "source", "text").unionByName(entry(read("pages"), "page", "page_id", "page_id", "url", "html"))

    return postings.open_index(spark, _folder(spark, sf_dir, "words", ["documents", "pages"], lambda folder, slices: postings.publish(spark, folder, found(), slices=slices)))
