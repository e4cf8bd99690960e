"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, and every character n-gram of length 1 to 3 is hashed into a bucket with an embedding.
The embeddings of all n-grams of the whole text are averaged and a linear softmax gives the languages.  The
model is fitted by stochastic gradient descent in numpy on the driver, on a sample of labelled rows whose size
is bounded by SAMPLE_PER_LANG and SAMPLE: with more than SAMPLE / SAMPLE_PER_LANG languages each has an equal part of
SAMPLE, and one row at least.  A row comes to the driver as the bytes of its bucket counts (6 * BUCKETS at most), not as
text.  A temperature fitted on a held-back part of the sample calibrates the scores.  A text is rejected
if its calibrated score is below a threshold that keeps KEEP of the held-back rows, or if it is strange to the language found: its n-grams' mean
log-likelihood under that language's own n-grams, for n of them, lies further below the held-back rows' median than APART + SHORT / sqrt(n) (a mean
of few varies more), and so does that of its words without digits, if it has any: numbers and keys among words don't make a text strange.

Because averaging is linear, prediction counts the buckets of a text and multiplies once: whole texts of any
length take a fixed amount of memory.

Defined results: a null text, or one without a letter, gives `und`, score 0 and rejected; a null doc_id is
never trained on and never held out; rows with a null language are predicted but not learned from; repeated rows are
predicted each; an empty table gives an empty result; if there is nothing to learn from, every text is `und`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, own

#: Buckets of hashed n-grams, and the width of an embedding.
BUCKETS, WIDTH = 1 << 14, 16
#: Bounds of the training sample: rows of a language, and rows of all languages (but one for each at least).
SAMPLE_PER_LANG, SAMPLE = 500, 4096
#: Share of held-back rows that the rejection threshold must keep.
KEEP = 0.999
#: How far a text's mean log-likelihood may lie below the median at any length, and what short texts may add; the weight of unseen n-grams.
APART, SHORT, UNSEEN = 2.7, 4.0, 0.05
#: Words that hold a digit.
NUMBERED = re.compile(r"\S*\d\S*")
#: Characters hashed at a time.
CHUNK = 1 << 20


def buckets(text: str) -> np.ndarray:
    """How often each bucket occurs among all n-grams (1 to 3 characters) of the lower-cased text."""
    counts = np.zeros(BUCKETS, np.float64)
    text = text.lower()
    for at in range(0, len(text), CHUNK):
        c = np.frombuffer(text[max(0, at - 2) : at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        fresh = 0 if at == 0 else 2  # the two characters before the chunk only begin n-grams
        h = c * np.uint32(2654435761)
        counts += np.bincount((h[fresh:] >> np.uint32(18)), minlength=BUCKETS)
        for n in (2, 3):
            if len(c) >= n:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + c[n - 1 :] * np.uint32(3266489917)
                counts += np.bincount(h[max(0, fresh - n + 1) :] >> np.uint32(18), minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    #: Embedding table times softmax weights: one row for each bucket, one column for each language.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    #: Log-likelihood of each bucket in each language, and the least mean of a text without end.
    likely: np.ndarray | None = None
    least: float = -math.inf

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score and whether it is rejected."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        counts = buckets(text)
        p = softmax(((counts @ self.table) / counts.sum() + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        strange = self.strange(counts, best)
        if strange and has_letter(words := NUMBERED.sub(" ", text)):
            strange = self.strange(buckets(words), best)
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold or strange)
    def strange(self, counts: np.ndarray, lang: int) -> bool:
        n = counts.sum()
        return self.likely is not None and bool(counts @ self.likely[:, lang] / n < self.least - SHORT / math.sqrt(n))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 12, seed: int = 7) -> Model:
    """Stochastic gradient descent on (buckets, counts) pairs; every tenth row is held back to calibrate."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    y, rng = np.array([langs.index(x) for x in labels]), np.random.default_rng(seed)
    embed, weight, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (WIDTH, len(langs))), np.zeros(len(langs))
    shares = [(at, n / n.sum()) for at, n in features]
    back = np.arange(len(y)) % 10 == 9 if len(y) >= 50 else np.zeros(len(y), bool)
    rows = np.flatnonzero(~back)
    for epoch in range(epochs):
        rate = 4.0 * (1 - epoch / epochs)
        for i in rng.permutation(rows):
            at, share = shares[i]
            mean = share @ embed[at]
            slope = softmax((mean @ weight + bias)[None])[0]
            slope[y[i]] -= 1
            to_mean = weight @ slope
            weight -= 0.5 * rate * np.outer(mean, slope)
            bias -= 0.05 * rate * slope
            embed[at] -= rate * np.outer(share / max(share.max(), 1e-9) * 0.25, to_mean)
    table = embed @ weight
    check = np.flatnonzero(back) if back.any() else rows
    logits = np.array([share @ table[at] + bias for at, share in (shares[i] for i in check)])
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in np.geomspace(0.05, 20, 49)}
    temperature = min(losses, key=losses.get)
    best = softmax(logits / temperature).max(1)
    threshold = float(min(np.quantile(best, 1 - KEEP), 0.5))
    if not back.any():
        return Model(langs, table, bias, float(temperature), threshold)
    seen = np.zeros((BUCKETS, len(langs)))
    for i in rows:
        seen[shares[i][0], y[i]] += shares[i][1]
    likely = np.log((1 - UNSEEN) * seen / np.maximum(seen.sum(0), 1e-9) + UNSEEN / BUCKETS)
    means = np.array([shares[i][1] @ likely[shares[i][0], k] for i, k in zip(check, logits.argmax(1), strict=True)])
    return Model(langs, table, bias, float(temperature), threshold, likely, float(np.median(means)) - APART)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out, spread over all of them by a hash of the id."""
    known = docs.select(own(docs, id_col).alias("id"), own(docs, text_col).alias("text"), own(docs, lang_col).cast("string").alias("lang"), held_out.alias("held_out")).where(
        "lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL AND NOT held_out"
    )
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()  # a row for each language
    if not sizes:
        return fit([], [])
    share = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    each = max(1, min(SAMPLE_PER_LANG, SAMPLE // len(sizes)))
    # as an Arrow table it needs no further Python workers on the executors
    rates = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array([r.lang for r in sizes], pa.string()), "rate": pa.array([each / r.n for r in sizes], pa.float64())}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    n = buckets(text)
                    nonzero = np.flatnonzero(n)
                    rows.append((lang, at, nonzero.astype("<u2").tobytes(), n[nonzero].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.binary(), pa.binary()))], ["lang", "at", "buckets", "counts"]
            )

    sample = (
        known.withColumn("at", share)
        .join(F.broadcast(rates), "lang")
        .where(F.col("at") < F.col("rate"))
        .select("lang", "text", "at")
        .mapInArrow(count, "lang string, at double, buckets binary, counts binary")
        .orderBy("at", "lang")
        .limit(2 * each * len(sizes))
        .collect()
    )
    return fit([(np.frombuffer(r.buckets, "<u2").astype(np.int64), np.frombuffer(r.counts, "<f4").astype(np.float64)) for r in sample], [r.lang for r in sample])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", names: Sequence[str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs' rows with the language, its score and whether it is rejected, in one map over whole texts without a shuffle.

    Columns of docs with the given names are replaced.  The model is a table of BUCKETS rows and a column for each
    language, so its broadcast is bounded by the number of languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [pa.field(n, t) for n, t in zip(names, (pa.string(), pa.float64(), pa.bool_()), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            extra = [pa.array([f[k] for f in found], field.type) for k, field in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], schema=pa.schema([*(f.with_name(c) for f, c in zip(batch.schema, kept, strict=False)), *new]))

    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(*[own(docs, c) for c in kept], own(docs, text_col).alias(fresh(docs, "text")[0]))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    return rows.toDF(*(f"c{k}" for k in range(len(rows.columns)))).mapInArrow(run, schema)  # a name may hold a point
