"""Masked pseudo-likelihood scores from a bidirectional window network.

Every word of a document is predicted from the two words on either side of it, and the summed conditional
log-probabilities score the document.  The network adds the neighbours' embeddings, each scaled by weights of
its position, takes the hyperbolic tangent, and predicts the word through a two-level softmax: its class, then
its place in the class.  Both levels are exact distributions over the vocabulary.

Vocabulary: the corpus's most frequent lower-case words, by exact counts over all documents; other words share
hashed buckets, and a third level predicts the word within its bucket: by its share of the bucket's count in all
documents, with one count more for all unseen words, which are spelled in UTF-8 bytes of equal chance.  So every token is
predicted whole, and the words that are known grow with the corpus: the next SECOND most frequent ones are looked up in the
map, all others are joined by Spark.  Training: the documents are dealt by hash to ROUNDS rounds.  In each, every partition of the corpus
trains its own copy of the network on its documents of the round, in numpy, by adaptive gradient steps from common weights, and
Spark averages the copies row by row, weighted by how often a partition saw the row; the next round goes on from there.  So every
document is learned from once, what is gathered grows with their number, and only the averaged network (fixed size) reaches the driver.

Texts are read twice: for the counts, and to write their ids to the shared folder, from where all rounds and the scoring read them.

Memory: tokens are processed in blocks of BLOCK, and long texts are split at white space into chunks, whole.

Defined results: a null or empty text has no words, sum 0 and mean null; a null doc_id is kept; repeated rows
are learned from and scored each; words tied in count rank by their letters; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, shared_folder

#: Classes and places in a class (their product is the vocabulary), buckets for rare words, and the network's width.
CLASSES, PLACES, BUCKETS, WIDTH = 64, 64, 512, 16
VOCABULARY = CLASSES * PLACES
#: Rare words that are looked up in the map (a broadcast); the others are joined.
SECOND = 1 << 17
#: Positions of the neighbours; id 0 pads the ends of documents.
NEIGHBOURS, PAD = (-2, -1, 1, 2), 0
#: Tokens that are worked on at once in scoring, in a training step and in a softmax (whose table stays in the processor's cache), distinct words that a partition counts before it hands them on, characters split at once, bytes of a worker's cache.
BLOCK, STEP, SLICE, COUNTED, CHUNK, CACHE = 1 << 16, 1 << 13, 1 << 11, 1 << 18, 1 << 20, 1 << 26
#: Logits within this size need no maximum taken off before their exponential.
NEAR = 60
#: Classes of at most FEW tokens are worked on TOGETHER.
FEW, TOGETHER = 128, 16
#: Step size of the adaptive gradient; rounds, each over its own part of the documents, after which the copies are averaged.
RATE, ROUNDS = 0.08, 3


def chunks(text: str | None) -> Iterator[str]:
    """Pieces of a whole text that end at white space, in lower case."""
    at, text = 0, text or ""
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end].lower()
        at = end


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def handed_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for piece in chunks(text):
                counts.update(piece.split())
                if len(counts) > COUNTED:
                    yield handed_on()
                    counts.clear()
    yield handed_on()


def bucket(word: str) -> int:
    return VOCABULARY - BUCKETS + zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


class Ids(dict):
    """Ids of words; rare ones get their bucket."""

    def __init__(self, known: list[str]) -> None:
        super().__init__(zip(known, range(1, len(known) + 1), strict=True))
        self.room = CACHE

    def __missing__(self, word: str) -> int:
        found = bucket(word)
        self.room -= len(word) + 64
        if self.room > 0:
            self[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        pieces = [np.fromiter(map(self.__getitem__, words), np.int32, len(words)) for words in map(str.split, chunks(text))]
        return np.concatenate(pieces) if pieces else np.zeros(0, np.int32)


@dataclass
class Network:
    """All weights as rows of one table: embeddings, position scales, the inner bias, classes, places."""

    rows: np.ndarray

    SCALES = VOCABULARY
    INNER = SCALES + len(NEIGHBOURS)
    CLASS = INNER + 1
    PLACE = CLASS + CLASSES
    SIZE = PLACE + VOCABULARY

    @classmethod
    def first(cls, shares: np.ndarray, seed: int = 1) -> Network:
        """Small random embeddings; the softmaxes start at the words' shares in the corpus."""
        rng = np.random.default_rng(seed)
        rows = np.zeros((cls.SIZE, WIDTH + 1), np.float32)
        rows[:VOCABULARY, :WIDTH] = rng.normal(0, 0.1, (VOCABULARY, WIDTH))
        rows[PAD, :WIDTH] = 0
        rows[cls.SCALES : cls.INNER, :WIDTH] = 1 / len(NEIGHBOURS)
        by_class = shares.reshape(CLASSES, PLACES)
        rows[cls.CLASS : cls.PLACE, WIDTH] = np.log(by_class.sum(1))
        rows[cls.PLACE :, WIDTH] = np.log(by_class / by_class.sum(1, keepdims=True)).ravel()
        rows[cls.CLASS :, :WIDTH] = rng.normal(0, 0.05, (CLASSES + VOCABULARY, WIDTH))
        return cls(rows)

    def run(self, stream: np.ndarray, slope: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of each token of a stream (0 at pads); adds the gradient of their negative sum to slope.

        Tokens are worked on in order of their class, so a class's tokens are one slice.
        """
        n, reach = len(stream), max(NEIGHBOURS)
        rows, d = self.rows, WIDTH
        at = np.flatnonzero(stream != PAD)
        group = (stream[at] // PLACES).astype(np.int16)
        order = np.argsort(group, kind="stable")
        at, group = at[order], group[order].astype(np.int64)
        place = stream[at] % PLACES
        x = np.zeros((n + 2 * reach, d), np.float32)
        x[reach : n + reach] = rows[:VOCABULARY, :d].take(stream, 0)
        scales = rows[self.SCALES : self.INNER, :d]
        z = x[reach + NEIGHBOURS[0] :][:n] * scales[0]
        for o, s in zip(NEIGHBOURS[1:], scales[1:], strict=True):
            z += x[reach + o :][:n] * s
        h = np.ones((len(at), d + 1), np.float32)  # the last column meets the biases
        np.tanh(z.take(at, 0) + rows[self.INNER, :d], out=h[:, :d])
        dh = np.zeros((len(at), d), np.float32)

        ones, starts = np.ones(PLACES, np.float32), np.arange(SLICE) * PLACES  # classes are as many as places
        # h lies between -1 and 1, so a row's logits are within the sum of its weights' sizes
        bounds = np.abs(rows[self.CLASS :]).sum(1).reshape(-1, PLACES).max(1)
        far = dict(zip(range(self.CLASS, self.SIZE, PLACES), (bounds >= NEAR).tolist(), strict=True))

        def level(part: slice, first: int, goal: np.ndarray) -> np.ndarray:
            """Log-probability of the goals under the PLACES rows from first on, with their slopes if asked for."""
            own, w = h[part], rows[first : first + PLACES]
            p = own @ w.T
            if far[first]:  # far apart logits need their own maxima
                p -= p.max(1, keepdims=True)
            at_goal = starts[: len(goal)] + goal
            flat = p.reshape(-1)
            mine = flat.take(at_goal)
            np.exp(p, out=p)
            total = p @ ones
            if slope is not None:
                flat[at_goal] -= total  # total times the slope of the logits
                share = 1 / total[:, None]
                slope[first : first + PLACES] += p.T @ (own * share)
                dh[part] += (p @ w[:, :d]) * share
            return mine - np.log(total)

        log_p = np.zeros(len(at), np.float32)
        for start in range(0, len(at), SLICE):
            own = slice(start, min(start + SLICE, len(at)))
            log_p[own] = level(own, self.CLASS, group[own])
        cuts = np.searchsorted(group, np.arange(CLASSES + 1))
        sizes = np.diff(cuts)
        for c in np.flatnonzero((sizes > FEW) | (sizes > 0) & list(far.values())[1:]).tolist():
            for start in range(cuts[c], cuts[c + 1], SLICE):
                own = slice(start, min(start + SLICE, cuts[c + 1]))
                log_p[own] += level(own, self.PLACE + c * PLACES, place[own])
        few = np.flatnonzero((sizes > 0) & (sizes <= FEW) & ~np.array(list(far.values())[1:]))
        few = few[np.argsort(sizes[few], kind="stable")]
        for some in (few[k : k + TOGETHER] for k in range(0, len(few), TOGETHER)):  # classes of few tokens together, each as long as the longest
            own = cuts[some][:, None] + np.arange(sizes[some].max())
            real = own < cuts[some + 1][:, None]
            own[~real] = 0
            hs, w, goal = h[own], rows[self.PLACE :].reshape(CLASSES, PLACES, d + 1)[some], place[own]
            p = hs @ w.transpose(0, 2, 1)
            mine = np.take_along_axis(p, goal[..., None], 2)[..., 0]
            np.exp(p, out=p)
            total = p @ ones
            if slope is not None:
                np.put_along_axis(p, goal[..., None], (np.take_along_axis(p, goal[..., None], 2)[..., 0] - total)[..., None], 2)
                share = (real / total).astype(np.float32)[..., None]
                slope[self.PLACE :].reshape(CLASSES, PLACES, d + 1)[some] += p.transpose(0, 2, 1) @ (hs * share)
                dh[own[real]] += ((p @ w[:, :, :d]) * share)[real]
            log_p[own[real]] += (mine - np.log(total))[real]
        out = np.zeros(n, np.float32)
        out[at] = log_p
        if slope is not None:
            dz = np.zeros((n + 2 * reach, d), np.float32)
            dz[reach + at] = dh * (1 - h[:, :d] ** 2)
            slope[self.INNER, :d] += dz.sum(0)
            dx = np.zeros((n, d), np.float32)
            for k, o in enumerate(NEIGHBOURS):
                slope[self.SCALES + k, :d] += np.einsum("ij,ij->j", dz[reach : reach + n], x[reach + o :][:n])
                dx += dz[reach - o :][:n] * scales[k]
            for k in range(d):
                slope[1:VOCABULARY, k] += np.bincount(stream, dx[:, k], VOCABULARY)[1:]
        return out


def blocks(docs: Iterator[np.ndarray], least: int) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Streams of `least` tokens or somewhat more with pads between documents, and the lengths of the documents in them."""
    held: list[np.ndarray] = []
    lengths: list[int] = []
    gap, size = np.full(max(NEIGHBOURS), PAD, np.int32), 0
    for ids in docs:
        held += [ids, gap]
        lengths.append(len(ids))
        size += len(ids) + len(gap)
        if size >= least:
            yield np.concatenate(held), lengths
            held, lengths, size = [], [], 0
    if held:
        yield np.concatenate(held), lengths


def windows(stream: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Equal parts of a stream, of about `size` tokens: first, last, and the part with its neighbours on both sides."""
    reach = max(NEIGHBOURS)
    cuts = np.linspace(0, len(stream), max(1, round(len(stream) / size)) + 1).astype(int).tolist()
    for at, end in zip(cuts, cuts[1:]):
        yield at, end, stream[max(0, at - reach) : end + reach]


def train_copy(network: Network, docs: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A copy of the network after one pass over a partition's documents, and how often each row was seen."""
    copy, seen = Network(network.rows.copy()), np.zeros(Network.SIZE)
    squares, slope, change = np.full(copy.rows.shape, 1e-4, np.float32), np.empty(copy.rows.shape, np.float32), np.empty(copy.rows.shape, np.float32)
    for stream, _ in blocks(docs, 2 * STEP):
        for _, _, part in windows(stream, STEP):
            slope[:] = 0
            copy.run(part, slope)
            slope /= np.float32(max(1, len(part)) ** 0.5)
            squares += np.multiply(slope, slope, out=change)
            np.divide(slope, np.sqrt(squares, out=change), out=change)
            copy.rows -= np.multiply(change, np.float32(RATE), out=change)
            tokens = np.bincount(part, minlength=VOCABULARY)
            tokens[PAD] = 0
            seen[:VOCABULARY] += tokens
            seen[Network.SCALES : Network.PLACE] += tokens.sum()
            seen[Network.PLACE :] += np.repeat(tokens.reshape(CLASSES, PLACES).sum(1), PLACES)
    return copy.rows, seen


class Codes(dict):
    """Codes of words, by one look-up a word: known words, the next most frequent ones, and a code for each bucket of all others.

    ids gives a code's id for the network, shares the log-share within its bucket (the third level): 0 for known words, and for the
    words that have to be joined minus the log of the bucket's count, to which the join adds the log of the word's own.
    """

    def __init__(self, known: list[str], second: dict[str, int], totals: np.ndarray) -> None:
        super().__init__(zip([*known, *second], range(1, len(known) + len(second) + 1), strict=True))
        self.logs, self.first, self.room = np.log(totals + 1.0), len(self) + 1, CACHE
        buckets = np.fromiter(map(bucket, second), np.int32, len(second))
        shares = np.log(np.fromiter(second.values(), np.float64, len(second))) - self.logs[buckets - VOCABULARY + BUCKETS]
        self.ids = np.concatenate([np.arange(len(known) + 1), buckets, np.arange(VOCABULARY - BUCKETS, VOCABULARY)]).astype(np.int32)
        self.shares = np.concatenate([np.zeros(len(known) + 1), shares, -self.logs])

    def __missing__(self, word: str) -> int:
        found = self.first + bucket(word) - VOCABULARY + BUCKETS
        self.room -= len(word) + 64
        if self.room > 0:
            self[word] = found
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, float, Counter[str]]:
        """Ids of a text, the summed log-shares of its rare words, and those that have to be joined, with their numbers."""
        ids, total, rest = [np.zeros(0, np.int32)], 0.0, Counter()
        for piece in chunks(text):
            words = piece.split()
            codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            ids.append(self.ids[codes])
            total += float(self.shares[codes].sum())
            rest.update([words[i] for i in np.flatnonzero(codes >= self.first).tolist()])
        return np.concatenate(ids), total, rest


@dataclass
class Model:
    known: list[str]
    network: Network
    #: Counts of the next most frequent words, counts of all rare words of each bucket, and the counts of all words as a table (word, n).
    second: dict[str, int] = field(default_factory=dict)
    totals: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    counts: DataFrame | None = None

    def score(self, docs: Iterator[np.ndarray]) -> Iterator[tuple[int, float]]:
        """Number of words and summed log-probability of each document."""
        gap = max(NEIGHBOURS)
        for stream, lengths in blocks(docs, BLOCK):
            log_p = np.concatenate([self.network.run(part)[at - max(0, at - gap) :][: end - at] for at, end, part in windows(stream, BLOCK)])
            ends = np.cumsum(np.array(lengths) + gap)
            sums = np.add.reduceat(log_p.astype(np.float64), np.concatenate([[0], ends[:-1]]))
            yield from zip(lengths, sums.tolist(), strict=True)


def first_model(docs: DataFrame, text_col: str = "text") -> Model:
    """The vocabulary, by counts of all words, with an untrained network."""
    texts = docs.select(F.col(text_col).alias("text"))
    counts = cut_lineage(texts.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # a histogram of the counts bounds what can be among the top, so no partition sends its own top rows to the driver
    size, least = VOCABULARY - BUCKETS - 1 + SECOND, 0
    for r in counts.groupBy(F.floor(F.log2("n") * 16).alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
        if size - r.words < 0 and size <= SECOND:  # all words of a full level would be too many for the driver
            break
        size, least = size - r.words, r.n
        if size <= 0:
            break
    ranked = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(VOCABULARY - BUCKETS - 1 + SECOND).collect()
    top, second = ranked[: VOCABULARY - BUCKETS - 1], ranked[VOCABULARY - BUCKETS - 1 :]
    spread = counts.groupBy((F.crc32(F.col("word").cast("binary")) % BUCKETS).cast("int").alias("bucket")).agg(F.sum("n").alias("n")).collect()
    shares, known = np.ones(VOCABULARY), [r.word for r in top]
    for r in spread:
        shares[VOCABULARY - BUCKETS + r.bucket] += r.n
    for i, r in enumerate(top):
        shares[i + 1] += r.n
        shares[bucket(r.word)] -= r.n
    totals = shares[VOCABULARY - BUCKETS :] - 1
    network = Network.first(np.maximum(shares, 1) / np.maximum(shares, 1).sum())
    return Model(known, network, {r.word: r.n for r in second}, totals, counts)


ENCODED = "row long, doc_id long, round int, ids binary, shares double, rest array<struct<word string, times long>>"


def encode(docs: DataFrame, model: Model, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's ids (16 bits each), summed log-shares and words to join, written once to the shared folder; training and scoring read them there."""
    shared = docs.sparkSession.sparkContext.broadcast((model.known, model.second, model.totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, context = Codes(*shared.value), TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for batch in batches:
            found = [codes.of(text.as_py()) for text in batch.column(2)]  # one text at a time
            rest = [f[2] for f in found]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rest])]), pa.int32())
            rare = pa.StructArray.from_arrays([pa.array([w for x in rest for w in x], pa.string()), pa.array([k for x in rest for k in x.values()], pa.int64())], ["word", "times"])
            ids, shares = pa.array([f[0].astype("<u2").tobytes() for f in found], pa.binary()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(batch))), batch.column(0), batch.column(1), ids, shares, pa.ListArray.from_arrays(ends, rare)], ["row", "doc_id", "round", "ids", "shares", "rest"])
            row += len(batch)

    own_id = F.col(id_col) if id_col else F.lit(None)
    rows = docs.select(own_id.cast("long").alias("doc_id"), F.pmod(F.xxhash64(text_col), F.lit(ROUNDS)).cast("int").alias("round"), F.col(text_col).alias("text"))
    folder = f"{shared_folder(docs.sparkSession)}/words-{uuid.uuid4().hex}"
    rows.mapInArrow(run, ENCODED).write.parquet(folder)
    return docs.sparkSession.read.schema(ENCODED).parquet(folder)


def ids_in(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(ids.as_py(), "<u2").astype(np.int32) for ids in column)


def fit(encoded: DataFrame, network: Network) -> Network:
    """The averaged network of all partitions."""
    fields = [f"w{k}" for k in range(WIDTH + 1)]
    for part in range(ROUNDS):
        shared = encoded.sparkSession.sparkContext.broadcast(network)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows, seen = train_copy(shared.value, (ids for batch in batches for ids in ids_in(batch.column(0))))
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at]), *(pa.array(rows[at, k].astype(np.float64)) for k in range(WIDTH + 1))], ["row", "seen", *fields])

        copies = encoded.where(F.col("round") == part).select("ids").mapInArrow(run, "row long, seen double, " + ", ".join(f"{f} double" for f in fields))
        averaged = copies.groupBy("row").agg(*[(F.sum(F.col(f) * F.col("seen")) / F.sum("seen")).alias(f) for f in fields]).collect()  # a network's rows at most
        rows = network.rows.copy()  # what no partition saw keeps its weights
        for r in averaged:
            rows[r.row] = r[1:]
        network = Network(rows)
    return network


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """The vocabulary and the averaged network of docs."""
    model = first_model(docs, text_col)
    return replace(model, network=fit(encode(docs, model, None, text_col), model.network))


def scores(encoded: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_prob (sum) and mean_log_prob of every encoded row."""
    if model.counts is None:
        raise ValueError("the model has no counts of words")
    shared = encoded.sparkSession.sparkContext.broadcast(model.network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model([], shared.value)
        for batch in batches:
            found = list(own.score(ids_in(batch.column(3))))
            n, sums = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.float64) + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(sums)], ["row", "doc_id", "n_words", "known"])

    rows = encoded.select("row", "doc_id", "shares", "ids").mapInArrow(run, "row long, doc_id long, n_words long, known double")
    # one row for each rare word and document; a word's rows need no texts
    words = encoded.select("row", F.explode("rest").alias("x")).select("row", "x.*").join(model.counts, "word", "left")
    unseen = -(F.octet_length("word") + 1) * math.log(257)  # the word's bytes and their end
    added = words.groupBy("row").agg(F.sum(F.col("times") * F.coalesce(F.log("n"), unseen)).alias("added"))
    log_prob = F.col("known") + F.coalesce("added", F.lit(0.0))
    return rows.join(added, "row", "left").select("doc_id", "n_words", log_prob.alias("log_prob"), F.when(F.col("n_words") > 0, log_prob / F.col("n_words")).alias("mean_log_prob"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob (sum) and mean_log_prob of every row."""
    return scores(encode(docs, model, id_col, text_col), model)


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of the texts that the model learns from: they are read for the counts and for their ids, which then serve training and scoring."""
    model = first_model(docs, text_col)
    encoded = encode(docs, model, id_col, text_col)
    return scores(encoded, replace(model, network=fit(encoded, model.network)))
