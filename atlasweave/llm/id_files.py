"""Token ids in files of patched frame-of-reference blocks.

Documents are dealt to files by ranges of (id, place), so that files in order hold documents in ascending id order, and each task encodes and
writes its own range in one pass.  A file's rows are segments of whole documents; a segment's ids are cut into blocks of BLOCK.  A block
stores its least id, the other ids less that at a width that takes a given percentile of them, and its outliers in an exception
list of positions and values; the segment's index says where each block starts, so a reader decodes only the blocks that it needs.

Files are Parquet with these segments as rows: Spark's committer makes a lost task's files vanish, and segments are pruned by the least and
greatest numbers that Parquet keeps of their columns.

Defined results: a null text is empty and still gives its end id; null ids come first; rows with one id follow each other in order of
their place in the table, so a repeated id may fill several files; other columns are ignored; an empty table gives files without rows.
A document is decoded with its segment, so a task holds one segment of SEGMENT ids, or one longer document, at a time.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MARKS, NOT_SIMPLE, byte_letters, numbered, sized
from .token_counts import CACHED, WHITE, load, pre_token_pattern

#: Ids of a block, ids after which a segment ends with its document, and the share of a block's ids that its width takes.
BLOCK, SEGMENT, PERCENT = 1 << 10, 1 << 17, 90
#: Bytes of a worker's caches: that of chunks and their words has half more, that of chunks with other than simple characters a quarter.
CACHE_BYTES = 3 << 25
#: A block's head: least id, number of ids, number of exceptions, width in bits.
HEAD = np.dtype([("least", "<u4"), ("n", "<u2"), ("outliers", "<u2"), ("width", "u1")])
SCHEMA = "part int, segment int, first long, n_ids long, starts array<int>, blocks binary, doc_ids array<long>, doc_tokens array<long>"
ARROW = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("starts", pa.list_(pa.int32())), ("blocks", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))]
)

_cache: dict[str, _Ids] = {}
id_of = attrgetter("id")


def bits(values: np.ndarray) -> np.ndarray:
    """How many bits each value takes (0 for 0)."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1))).astype(np.int64) + 1, 0)


def encode(ids: np.ndarray, percent: int = PERCENT) -> tuple[list[int], bytes]:
    """Where each block starts, and the blocks, of 32-bit ids.  Blocks of one width are packed together."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    rows = np.full((blocks, BLOCK), 0, np.int64)
    rows.reshape(-1)[:n] = ids
    held = np.full(blocks, BLOCK)
    held[-1:] = n - BLOCK * (blocks - 1)
    inside = np.arange(BLOCK)[None] < held[:, None]
    least = np.where(inside, rows, np.iinfo(np.int64).max).min(1) if blocks else np.zeros(0, np.int64)
    rest = np.where(inside, rows - least[:, None], 0)
    ordered = np.sort(np.where(inside, rest, -1), 1)
    at = BLOCK - held + np.maximum(0, -(-held * percent // 100) - 1)  # the padding (-1) comes first
    width = bits(ordered[np.arange(blocks), at]) if blocks else np.zeros(0, np.int64)
    outlier = rest >= (1 << width)[:, None]
    packed = np.where(outlier, 0, rest)
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        flat = np.unpackbits(packed[which].astype("<u4").view(np.uint8).reshape(-1, 4), 1, count=w, bitorder="little").reshape(len(which), -1)
        for b, row in zip(which.tolist(), np.packbits(flat, 1, bitorder="little"), strict=True):
            bodies[b] = row[: -(-int(held[b]) * w // 8)].tobytes()
    starts, out, size = [], [], 0
    for b in range(blocks):
        place = np.flatnonzero(outlier[b])
        head = np.array([(least[b], held[b], len(place), width[b])], HEAD).tobytes()
        piece = head + bodies[b] + place.astype("<u2").tobytes() + rest[b, place].astype("<u4").tobytes()
        starts.append(size)
        out.append(piece)
        size += len(piece)
    return starts, b"".join(out)


def decode(starts: list[int], blocks: bytes) -> np.ndarray:
    """The ids of the blocks that begin at the given places."""
    out = []
    for at in starts:
        least, n, outliers, width = (int(x) for x in np.frombuffer(blocks, HEAD, 1, at)[0])
        at += HEAD.itemsize
        size = -(-n * width // 8)
        if width:
            whole = 16 if width <= 16 else 32
            spread = np.zeros((n, whole), np.uint8)
            spread[:, :width] = np.unpackbits(np.frombuffer(blocks, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
            rest = np.packbits(spread, bitorder="little").view(f"<u{whole // 8}").astype(np.int64)
        else:
            rest = np.zeros(n, np.int64)
        at += size
        if outliers:
            rest[np.frombuffer(blocks, "<u2", outliers, at)] = np.frombuffer(blocks, "<u4", outliers, at + 2 * outliers)
        out.append(rest + least)
    return np.concatenate(out).astype("<u4") if out else np.zeros(0, "<u4")


class _Kept(dict):
    """What a function gives for a string, remembered within a number of bytes, beyond which it starts anew."""

    def __init__(self, make: Callable[[str], bytes], room: int) -> None:
        super().__init__()
        self.make, self.size, self.room = make, room, room

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) <= CACHED:
            self.room -= len(key) + len(found) + 150
            if self.room < 0:
                self.clear()
                self.room = self.size
            self[key] = found
        return found


class _Ids:
    """Ids (as bytes) of texts by a cache of words and of chunks between white space, which are words with marks for the most part.

    A vocabulary that drops white space gives the ids of a text's chunks one after the other.  Chunks of simple characters, in small letters,
    are split into words here, which the library's model encodes; all others are encoded by the library as they stand.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.model, letters, split = self.tokenizer.model.tokenize, byte_letters(), pre_token_pattern().findall
        self.strange, self.special = re.compile(NOT_SIMPLE).search, sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

        def chunk(text: str) -> bytes:
            if not text.isalpha():
                core = text.rstrip(MARKS)
                if core.isalpha():  # a word with marks behind it, which are one part
                    return simple[core] + simple[text[len(core) :]]
                parts = split(text)
                if len(parts) > 1:
                    return b"".join(map(simple.__getitem__, parts))
            spelled = text if text.isascii() else text.encode().decode("latin-1").translate(letters)  # visible ASCII stands for itself
            return array("I", map(id_of, self.model(spelled))).tobytes()

        self.simple = simple = _Kept(chunk, CACHE_BYTES + CACHE_BYTES // 2)
        self.any = _Kept(lambda text: self.library(text) if self.odd(text) else self.simple[text.lower()], CACHE_BYTES // 4)

    def odd(self, text: str) -> bool:
        return bool(self.strange(text)) or any(s in text for s in self.special)

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def document(self, text: str) -> bytes:
        if self.odd(text):
            return b"".join(map(self.any.__getitem__, filter(None, WHITE.split(text))))
        return b"".join(map(self.simple.__getitem__, text.lower().split()))


def ids_of(path: str) -> _Ids:
    """The cache of a vocabulary, once for each process; the vocabulary must be one that drops white space and small-cases letters."""
    if path not in _cache:
        found, probe = _Ids(path), "Ab cD, 7up's\nx"
        if found.document(probe) != found.library(probe):
            raise ValueError(f"{path} doesn't encode the pieces between white space one by one in small letters")
        _cache[path] = found
    return _cache[path]


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each with the end id after it, as files in ascending id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end, context = ids_of(tokenizer_path), array("I", [end_id]).tobytes(), TaskContext.get()
        part = context.partitionId() if context else 0
        names, blobs, held, first, segment = [], [], 0, 0, 0

        def cut() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(blobs), np.uint32)
            starts, packed = encode(ids)
            values = [[part], [segment], [first], [len(ids)], [starts], [packed], [names], [[len(b) // 4 for b in blobs]]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blob = (cache.document(text.as_py()) if text.is_valid else b"") + end
                names.append(doc)
                blobs.append(blob)
                held += len(blob) // 4
                if held >= SEGMENT:
                    yield cut()
                    names, blobs, first, segment, held = [], [], first + held, segment + 1, 0
        if blobs:
            yield cut()

    rows, place = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    dealt = rows.repartitionByRange("doc_id", *place).sortWithinPartitions("doc_id", *place)
    dealt.select("doc_id", "text").mapInArrow(run, SCHEMA).write.mode("errorifexists").parquet(folder)


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of a folder, with base: how many ids stand in the files before a segment's own."""
    found = spark.read.schema(SCHEMA).parquet(folder)
    totals = sorted((r.part, r.n) for r in found.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row for each file
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n
    return found.join(sized(spark.createDataFrame(bases, "part int, base long")), "part")


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of every document, from the files."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int64()))] * with_ids]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                at, starts, blocks, docs, lengths = (batch.column(k)[row].as_py() for k in range(5))
                ids, ends = decode(starts, blocks), np.cumsum(lengths)
                raw, begins = memoryview(ids.tobytes()), ends - lengths
                values = [docs, begins + at, lengths, [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]]
                if with_ids:
                    values.append([ids[a:b].astype(np.int64) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    rows = segments(spark, folder).select((F.col("base") + F.col("first")).alias("at"), "starts", "blocks", "doc_ids", "doc_tokens")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def read_range(spark: SparkSession, folder: str, start: int, n: int) -> DataFrame:
    """place and id of n ids from a place on: only the blocks that hold them are decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                at, starts, blocks = (batch.column(k)[row].as_py() for k in range(3))
                a, b = max(0, start - at), max(0, start + n - at)
                first = a // BLOCK
                ids = decode(starts[first : -(-b // BLOCK)], blocks)[a - first * BLOCK :][: b - a]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids)) + at + a, pa.int64()), pa.array(ids.astype(np.int64))], ["place", "id"])

    at = F.col("base") + F.col("first")
    hit = segments(spark, folder).where((at < start + n) & (at + F.col("n_ids") > start))
    return hit.select(at.alias("at"), "starts", "blocks").mapInArrow(run, "place long, id long")
