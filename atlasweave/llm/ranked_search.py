"""Ranked lexical search by a threshold-seeded join.

Texts are cut into terms once, and a forward index of the asked terms (each document's length, terms and counts) is written to the shared folder.  From
it come each term's document frequency, and the impacts that the term's best and kth best document have.  The kth impacts seed
the thresholds: an item's kth score is no less than that of the greatest of its terms' kth contributions, as k documents reach it by that
term alone.  An item's terms are sorted by their best contribution; the tail whose sum stays below the threshold is pruned, for a document that has
no other term can't reach it.  The remaining (essential) terms join documents with items; a pair stays a candidate if what its essential terms
contribute and the tail's best would suffice, and is then rescored exactly with all terms.  No document that belongs to the k best is lost, ties included.

Scale: items are dealt to blocks of about TERMS distinct terms, whose structures are broadcast and whose numbers are the only ones that
reach the driver; documents never leave their partition before they are scored, so neither a frequent term nor a long text makes a hot key.
Each task hands on candidates above the thresholds only, of which Spark keeps k an item and task before the final shuffle.

Defined results: a null text and one without a term take no part, neither as documents nor as items; repeated rows of an item are asked once, and
two texts under one id are two items; repeated documents are ranked each; null ids come first among equal scores; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: Rows (item, term) of a block of items on average at most, and cells (document, item) that are scored at a time.
TERMS, CELLS = 1 << 16, 1 << 18
#: Bytes of terms: digits, letters and all of non-ASCII; capitals become small letters, all other bytes spaces.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
FORWARD = "doc_id long, n long, term array<int>, tf array<long>"


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number for each distinct row), item_id and term of items(item_id, text), each term once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t) for i, text in enumerate(batch.column(2).to_pylist()) for t in sorted(set(terms(text)))]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.binary())], ["item", "item_id", "term"])

    asked = cut_lineage(items.select("item_id", "text").distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    return cut_lineage(asked.mapInArrow(run, "item long, item_id long, term binary"))


def forward(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the numbers and counts of the known terms of every document that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            ids, sizes, found, counts = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms(text.as_py())
                if words:
                    pairs = [(k, c) for w, c in Counter(words).items() if (k := number(w)) is not None]
                    ids.append(doc)
                    sizes.append(len(words))
                    found.append([k for k, _ in pairs])
                    counts.append([c for _, c in pairs])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "term", "tf"])

    return docs.select("doc_id", "text").mapInArrow(run, FORWARD)


@dataclass
class Postings:
    """The postings of some documents: for each, the document's place among them, the term, and its contribution to a score."""

    docs: int
    doc: np.ndarray
    term: np.ndarray
    worth: np.ndarray


def length_part(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents with n terms; in Python's integers where 64 bits could be too few."""
    if 50 * int(n.max(initial=0)) * docs < 2**63:
        return 50 + 50 * n * docs // total
    return np.array([50 + 50 * int(x) * docs // total for x in n], np.int64)


def impacts(batch: pa.RecordBatch, docs: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document's place, term and impact of all postings in rows of forward()."""
    n = batch.column("n").to_numpy(zero_copy_only=False)
    held = np.array(batch.column("term").value_lengths().to_numpy(zero_copy_only=False), np.int64)
    doc = np.repeat(np.arange(len(n)), held)
    term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("term", "tf"))
    return doc, term, 1_000_000_000 * tf // (1000 * tf + 20 * length_part(n, docs, total)[doc])


def best_impacts(index: DataFrame, docs: int, total: int, k: int) -> DataFrame:
    """term, best and kth: the greatest impact of each term, and the kth greatest (0 with fewer documents).

    A task gives the k greatest of each of its terms, equal ones counted together, so a term's rows are few whatever its frequency.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_term, kept_impact = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, term, impact = impacts(batch, docs, total)
            term, impact = np.concatenate([kept_term, term]), np.concatenate([kept_impact, impact])
            order = np.lexsort((-impact, term))
            term, impact = term[order], impact[order]
            first = np.flatnonzero(np.diff(term, prepend=-1))
            place = np.arange(len(term)) - np.repeat(first, np.diff(first, append=len(term)))
            kept_term, kept_impact = term[place < k], impact[place < k]
        yield pa.RecordBatch.from_arrays([pa.array(kept_term, pa.int32()), pa.array(kept_impact, pa.int64())], ["term", "impact"])

    counted = index.mapInArrow(run, "term int, impact long").groupBy("term", "impact").agg(F.count("*").alias("n"))
    reached = F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("impact")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("reached", reached)
    return ranked.groupBy("term").agg(F.max("impact").alias("best"), F.coalesce(F.max(F.when(F.col("reached") >= k, F.col("impact"))), F.lit(0).cast("long")).alias("kth"))


def seeded(asked: DataFrame, weights: DataFrame) -> DataFrame:
    """item, term, worth (of the best document), threshold and essential: whether the term's tail could reach the item's threshold.

    asked(item, term number), weights(term, w, best, kth).  A threshold of 0 leaves all terms essential.
    """
    rows = asked.join(F.broadcast(weights), "term").withColumn("worth", F.col("w") * F.col("best"))  # a row for each of the block's terms
    item = Window.partitionBy("item")
    tail = F.sum("worth").over(item.orderBy("worth", "term").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("threshold", F.max(F.col("w") * F.col("kth")).over(item)).withColumn("tail", tail)
    return rows.select("item", "term", "worth", "threshold", (F.col("tail") >= F.col("threshold")).alias("essential"))


@dataclass
class Plan:
    """A block's items as arrays: each term's weight; for essential and other terms, the items from first[t] to first[t + 1]; thresholds, and the best that an item's pruned terms give."""

    weight: np.ndarray
    threshold: np.ndarray
    pruned: np.ndarray
    essential: tuple[np.ndarray, np.ndarray]
    others: tuple[np.ndarray, np.ndarray]


def plan(rows: list[tuple[int, int, int, int, bool]], weight: np.ndarray) -> Plan:
    item, term, worth, threshold = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    essential = np.array([r[4] for r in rows], bool)
    n = int(item.max(initial=-1)) + 1
    least, rest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    least[item] = threshold
    np.add.at(rest, item[~essential], worth[~essential])

    def lists(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(term[chosen], kind="stable")
        return np.searchsorted(term[chosen][order], np.arange(len(weight) + 1)), item[chosen][order]

    return Plan(weight, least, rest, lists(essential), lists(~essential))


def totals(p: Postings, lists: tuple[np.ndarray, np.ndarray], items: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of contributions for all pairs (document, item) that the lists' terms join, and whether there are any."""
    first, listed = lists
    times = first[p.term + 1] - first[p.term]
    at = np.repeat(first[p.term] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
    cell = np.repeat(p.doc, times) * items + listed[at]
    worth = np.repeat(p.worth, times)
    size = p.docs * items
    if float(worth.max(initial=0)) * max(1, len(worth)) < 2**53:
        out = np.bincount(cell, worth, size).astype(np.int64)
    else:
        out = np.zeros(size, np.int64)
        np.add.at(out, cell, worth)
    return out, np.bincount(cell, minlength=size) > 0


def candidates(batch: pa.RecordBatch, p: Plan, docs: int, total: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows' places, items and exact scores of all pairs that reach their threshold, and how many pairs were rescored."""
    items = len(p.threshold)
    doc, term, impact = impacts(batch, docs, total)
    worth = impact * p.weight[term]
    step = max(1, CELLS // max(1, items))
    for begin in range(0, len(batch), step):
        a, b = np.searchsorted(doc, (begin, begin + step))
        here = Postings(min(step, len(batch) - begin), doc[a:b] - begin, term[a:b], worth[a:b])
        sums, met = totals(here, p.essential, items)
        chosen = np.flatnonzero(met & (sums + np.tile(p.pruned, here.docs) >= np.tile(p.threshold, here.docs)))
        if len(chosen):
            again = np.zeros(here.docs, bool)
            again[chosen // items] = True
            keep = again[here.doc]
            rest, _ = totals(Postings(here.docs, here.doc[keep], here.term[keep], here.worth[keep]), p.others, items)
            score = sums[chosen] + rest[chosen]
            good = score >= np.maximum(1, p.threshold[chosen % items])
            yield chosen[good] // items + begin, chosen[good] % items, score[good], len(chosen)


@dataclass
class Statistics:
    """Documents with a term, their terms with repeats, and what a search took: pairs of items and documents that a term joins, and those rescored."""

    docs: int
    terms: int


def scored(index: DataFrame, p: Plan, found: Statistics) -> DataFrame:
    """item, doc_id and score of all pairs that reach their thresholds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, item, score, _ in candidates(batch, p, found.docs, found.terms):
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def prepared(docs: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, Plan, list[int], Statistics] | None:
    """The forward index, the plan and the items of a block of (item, term) rows; None if no document has a term."""
    spark = docs.sparkSession
    rows = asked.select("item", "term").collect()  # one block
    items, words = sorted({r.item for r in rows}), sorted({bytes(r.term) for r in rows})
    known, place = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(items)}
    index = cut_lineage(forward(docs, known))
    counts = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    if not counts.docs:
        return None
    found = Statistics(counts.docs, counts.terms)
    frequency = {r.term: r.df for r in index.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each of the block's terms
    weight = np.array([math.floor(1000 * math.log((2 * found.docs + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(words))], np.int64)
    weights = best_impacts(index, found.docs, found.terms, k).join(F.broadcast(spark.createDataFrame([(t, int(w)) for t, w in enumerate(weight)], "term int, w long")), "term")
    numbers = spark.createDataFrame([(place[r.item], known[bytes(r.term)]) for r in rows], "item long, term int")
    return index, plan([tuple(r) for r in seeded(numbers, weights).collect()], weight), items, found


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score: the k highest-scoring rows of docs(doc_id, text) for every row of items(item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), "text"))
    blocks = max(1, -(-asked.count() // TERMS))
    parts = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        ready = prepared(docs, mine, k)
        if ready:
            index, p, numbers, found = ready
            names = docs.sparkSession.createDataFrame(list(enumerate(numbers)), "item long, asked long")
            hits = scored(index, p, found).join(F.broadcast(names), "item")  # the block's items
            order = Window.partitionBy("asked").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
            parts.append(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("asked", "rank", "doc_id", "score"))
    owners = asked.select(F.col("item").alias("asked"), "item_id").distinct()
    if not parts:
        return owners.select("item_id", F.lit(0).alias("rank"), F.col("asked").alias("doc_id"), F.col("asked").alias("score")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(owners, "asked").select("item_id", "rank", "doc_id", "score")
