"""Packing documents into training sequences by best-fit decreasing.

A document is first cut into full windows, which are sequences of their own; what remains is placed, longest
first, in the open window with the least room that still takes it.  A segment tree indexed by remaining
capacity finds that window in a few steps.  Each Spark partition packs its own documents while it tokenizes
them, so nothing is shuffled and a hot source cannot meet in one task; a partition leaves a few partly filled
windows at most.  Sequence ids hold the partition's number in the upper bits.  A lost task packs the same rows
in the same order again and so gives the same ids.

Defined results: a null text is empty and still gives its end token; a null doc_id stays null; repeated rows
are packed each; other columns are ignored; an empty table gives no pieces; ties go by row order.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MARKS, NOT_SIMPLE, byte_letters, char_class
from .token_counts import load

#: Bytes of a task's cache of chunks' ids (it starts anew beyond that), and characters of a chunk that is kept in it at most.
CACHE_BYTES, CACHED = 3 << 25, 256
#: Kinds of marks behind words that are remembered beside them.
FEW = 1 << 12
#: Sequences of one partition stay below this number.
IDS_PER_PARTITION = 1 << 33


class CapacityTree:
    """A segment tree over 0..capacity: how many open windows have each amount of room left."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at, count = room + self.size, self.count
        while at:
            count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least room of an open window that is at least `need`; -1 if there is none."""
        at, count = need + self.size, self.count
        if count[at]:
            return need
        while at > 1:  # climb until a right-hand sibling has windows
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.size:  # then go down to its leftmost one
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; lengths are 1..capacity."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, open_by_room, windows = CapacityTree(capacity), [[] for _ in range(capacity + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room < 0:
            room, at, windows = capacity, windows, windows + 1
        else:
            at = open_by_room[room].pop()
            tree.add(room, -1)
        window[i], offset[i] = at, capacity - room
        if room > need:
            open_by_room[room - need].append(at)
            tree.add(room - need, 1)
    return window, offset


class _Ids(dict):
    """Little-endian 32-bit ids of a chunk with the space or line feed before it; a miss is split and encoded."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        letter, number, self.room, self.marks = char_class("L"), char_class("N"), CACHE_BYTES, {}
        self.tokenize, self.letters = tokenizer.model.tokenize, byte_letters()
        self.split = re.compile(rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^\t\n\r {letter}{number}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+").findall

    def __missing__(self, chunk: str) -> bytes:
        core = chunk if chunk.isalpha() else chunk.rstrip(MARKS)
        if not core.isalpha():
            ids = self.encode(chunk if chunk[:1] == "\n" else " " + chunk)
        elif core is chunk:
            ids = self.word(" " + chunk)
        else:  # a word with marks behind it, which are a part of their own
            ids = self[core] + self.behind(chunk[len(core) :])
        if len(chunk) <= CACHED:
            self.room -= 2 * len(chunk) + len(ids) + 100
            if self.room < 0:
                self.clear()
                self.room = CACHE_BYTES
            self[chunk] = ids
        return ids

    def behind(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self.word(marks)
            if len(self.marks) < FEW and len(marks) <= CACHED:
                self.marks[marks] = ids
        return ids

    def word(self, part: str) -> bytes:
        """Ids of a part that the splitter leaves whole."""
        tokens = [t.id for t in self.tokenize(part.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(tokens)}I", *tokens)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.word, self.split(text)))

    def document(self, text: str) -> bytes:
        """Ids of a simple text.  Where white space stands singly, the text splits at its spaces and line feeds."""
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or "\t" in text or "\r" in text:
            return self.encode(text)
        first, *chunks = text.replace("\n", " \n").split(" ")
        return self.encode(first) + b"".join(map(self.__getitem__, chunks))


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    special = sorted(t.content for t in load(tokenizer_path).get_added_tokens_decoder().values())
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int64()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        ids_of = _Ids(tokenizer)  # most chunks are rare, so a later task would find few of its own here, and the worker may go on to other work
        odd = re.compile("|".join([NOT_SIMPLE, *map(re.escape, special)])).search
        end, context = np.array([end_id], "<u4").tobytes(), TaskContext.get()
        first, full = (context.partitionId() if context else 0) * IDS_PER_PARTITION, 0
        rest: list[tuple] = []

        def rows(pieces: list[tuple], sequence, offset) -> pa.RecordBatch:
            doc, start, length, crc, total, blob = zip(*pieces, strict=True)
            columns = [doc, start, length, crc, total, sequence, offset]
            if with_ids:
                columns.append([np.frombuffer(b, "<u4").astype(np.int64) for b in blob])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            whole: list[tuple] = []
            for doc, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = held.as_py()  # one text at a time
                if not text:
                    blob = end
                elif odd(text):
                    blob = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + end
                else:
                    blob = ids_of.document(text) + end
                total = len(blob) // 4
                for start in range(0, total, capacity):
                    piece = blob[4 * start : 4 * (start + capacity)]
                    row = (doc, start, len(piece) // 4, zlib.crc32(piece), total, piece if with_ids else None)
                    (whole if row[2] == capacity else rest).append(row)
            if whole:
                yield rows(whole, np.arange(full, full + len(whole)) + first, np.zeros(len(whole), np.int64))
                full += len(whole)
        if rest:
            window, offset = best_fit_decreasing(np.array([r[2] for r in rest]), capacity)
            yield rows(rest, window + first + full, offset)

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)
