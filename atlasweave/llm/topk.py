"""Exact top-k inner products with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; in each pivot's cell the distances are cut
into sorted annuli.  For a query the bound |q - x| >= |d(q, p) - d(x, p)| of the triangle inequality gives a
greatest possible score to each annulus, as q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2.  Round one expands a query's most promising annuli
until they hold enough vectors and so gets a score that k vectors reach for certain; round two visits
the other annuli in the order of their bounds and stops at the first that can't reach that score.  Inside an
annulus the vectors are sorted by distance and only the interval that the same bound leaves is scored.  The
result is exact.

Scale: annuli are described by one small row each (PIVOTS * RINGS at most).  A visit joins an annulus, not a vector, to a query,
and an annulus with many vectors is cut into slices of about SLICE rows by a hash of the id, so equal vectors
don't meet in one task; beyond QUERIES queries the visits of a slice are cut by a hash of the query as well.

Defined results: vectors that are null, or hold a null or non-finite component, take no part, neither as
queries nor as candidates; so do null ids.  A shorter vector counts as padded with zeros.  Ties go to the smaller id.  A
repeated id is a candidate each time and never its own; repeated query rows are asked once per distinct row.  With fewer than k candidates all are returned; an
empty table gives an empty result; other columns are ignored.  Scores are exact within 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: Pivots, annuli of a pivot's cell, and vectors in the sample that they are fitted on (all reach the driver).
PIVOTS, RINGS, SAMPLE = 32, 8, 2048
#: Vectors of a slice of an annulus, queries that one task gets at most on average, queries scored at a time.
SLICE, QUERIES, BLOCK = 1 << 13, 1 << 15, 1 << 8


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of longs) of the vectors that take part."""
    v = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def matrix(lists, width: int | None = None) -> np.ndarray:
    """Rows padded with zeros to one width, as 64-bit integers."""
    rows = [np.asarray(x, np.int64) for x in lists]
    width = max([width or 0, *map(len, rows)])
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: floating-point units where every sum fits 53 bits, else integers."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2**53 else a @ b.T


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, by differences: rounding errors stay far below SLACK."""
    v = v.astype(np.float64)
    return np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in pivots.astype(np.float64)], 1)


#: Bounds are loosened by this share, far above any rounding error of the distances.
SLACK = 1e-9


def upper_bound(q_norm: np.ndarray, q_dist: np.ndarray, near: np.ndarray, far: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Greatest possible score of a query against an annulus near..far whose longest vector has the given norm."""
    gap = np.maximum(0.0, np.maximum(near - q_dist, q_dist - far))
    ball = (q_norm**2 + norm**2 - gap**2) / 2  # falls with |q - x|, and |x| <= norm
    most = np.minimum(ball, q_norm * norm)
    return most + SLACK * (q_norm + norm + q_dist + far) ** 2 + 1


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal of the sample, after its vector nearest to the mean."""
    if not len(sample):
        return np.zeros((1, sample.shape[1] or 1), np.int64)
    away = ((sample - sample.mean(0)) ** 2).sum(1)
    chosen = [int(away.argmin())]
    away = distances(sample, sample[chosen])[:, 0]
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def index(vectors: DataFrame, pivots: np.ndarray, edges: np.ndarray) -> DataFrame:
    """vec_id, v, pivot, ring, dist and norm of every vector; ring r of a pivot ends at the r-th of its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1).to_pylist(), pivots.shape[1])
            wide = np.pad(pivots, ((0, 0), (0, v.shape[1] - pivots.shape[1])))
            d = distances(v, wide)
            pivot = d.argmin(1)
            dist = d[np.arange(len(d)), pivot]
            ring = (dist[:, None] > edges[pivot]).sum(1)
            norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(dist), pa.array(norm)], ["vec_id", "v", "pivot", "ring", "dist", "norm"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>, pivot int, ring int, dist double, norm double")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query row, ties to the smaller id."""
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def score_slice(queries: pd.DataFrame, home: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best vectors of a slice for every query that visits it, within the interval that its floor leaves."""
    out: list[tuple] = []
    if len(queries) and len(home):
        home = home.sort_values(["dist", "vec_id"], kind="stable")
        v, ids, dist, longest = matrix(home["v"]), home["vec_id"].to_numpy(), home["dist"].to_numpy(), float(home["norm"].max())
        queries = queries.sort_values("d", kind="stable")  # neighbours share most of their interval
        for at in range(0, len(queries), BLOCK):
            block = queries.iloc[at : at + BLOCK]
            q, d, floor = matrix(block["v"]), block["d"].to_numpy(), block["floor"].to_numpy()
            norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
            room = norm**2 + longest**2 - 2 * floor + 2 * SLACK * (norm + longest + d + dist[-1]) ** 2 + 2
            reach = np.sqrt(np.maximum(room, 0))  # infinite where there is no floor yet
            a, b = int(np.searchsorted(dist, (d - reach).min(), "left")), int(np.searchsorted(dist, (d + reach).max(), "right"))
            if a >= b:
                continue
            scores = inner(q, v[a:b])
            for query, row, s in zip(block["query_id"], block["row"], scores, strict=True):
                other = ids[a:b] != query
                s, n = s[other], ids[a:b][other]
                if len(s) > k:
                    keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                    s, n = s[keep], n[keep]
                order = np.lexsort((n, -s))[:k]
                out += [(query, row, x, y) for x, y in zip(n[order].tolist(), s[order].tolist(), strict=True)]
    return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query row with all other ids' rows."""
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    usable = quantised(own, scale, "vec_id", "embedding")
    sample = matrix([r.v for r in usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    pivots = choose_pivots(sample, PIVOTS)
    near = distances(sample, pivots) if len(sample) else np.zeros((0, 1))
    nearest = near.argmin(1)
    edges = np.array([np.quantile(near[nearest == p, p], np.arange(1, RINGS) / RINGS) if (nearest == p).any() else np.zeros(RINGS - 1) for p in range(len(pivots))])

    indexed = cut_lineage(index(usable, pivots, edges))
    cells = indexed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far"), F.max("norm").alias("norm"))
    known = cells.orderBy("pivot", "ring").toPandas()  # at most PIVOTS * RINGS rows
    pivot_of, held = known["pivot"].to_numpy(int), known["n"].to_numpy(int)
    slices = np.maximum(1, -(-held // SLICE))
    asked = cut_lineage(quantised(own.where("asks"), scale, "vec_id", "embedding").distinct().withColumn("row", F.xxhash64("vec_id", "v")))
    blocks = max(1, -(-asked.count() // QUERIES))
    if not len(known):
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("row").alias("score")).limit(0)

    def visits(second: bool):
        """Which slices each query visits: round one its best annuli, round two all others whose bound reaches its floor."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                v, floor = matrix(frame["v"], pivots.shape[1]), frame["floor"].to_numpy(float)
                d, norm = distances(v, np.pad(pivots, ((0, 0), (0, v.shape[1] - pivots.shape[1])))), np.sqrt((v.astype(np.float64) ** 2).sum(1))
                bound = upper_bound(norm[:, None], d[:, pivot_of], *(known[c].to_numpy()[None] for c in ("near", "far", "norm")))
                order = np.argsort(-bound, 1, kind="stable")
                before = np.cumsum(held[order], 1) - held[order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, before <= k, 1)  # k others and the query itself
                who, cell = np.nonzero(~first & (bound >= floor[:, None]) if second else first)
                times = slices[cell]
                who, cell = np.repeat(who, times), np.repeat(cell, times)
                piece = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                sent = frame.iloc[who].rename(columns={"vec_id": "query_id"})
                yield sent.assign(cell=cell, slice=piece, block=sent["row"] % blocks, d=d[who, pivot_of[cell]])[["cell", "slice", "block", "query_id", "row", "v", "d", "floor"]]

        return run

    # the small table of annuli as array columns: its index and its number of slices
    numbers = np.full(len(pivots) * RINGS, -1)
    numbers[pivot_of * RINGS + known["ring"].to_numpy(int)] = np.arange(len(known))
    at = F.col("pivot") * RINGS + F.col("ring")
    cell = F.array(*map(F.lit, numbers.tolist()))[at].cast("long")
    parts = F.array(*map(F.lit, slices.tolist()))[F.col("cell").cast("int")]
    homes = (
        indexed.withColumn("cell", cell)
        .withColumn("slice", F.pmod(F.xxhash64("vec_id", "v"), parts).cast("long"))
        .select("cell", "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "vec_id", "v", "dist", "norm")
    )

    def searched(queries: DataFrame, second: bool) -> DataFrame:
        key = ["cell", "slice", "block"]
        sent = queries.select("vec_id", "v", "row", "floor").mapInPandas(visits(second), "cell long, slice long, block long, query_id long, row long, v array<long>, d double, floor double")
        return sent.groupBy(*key).cogroup(homes.groupBy(*key)).applyInPandas(lambda a, b: score_slice(a, b, k), "query_id long, row long, vec_id long, score long")

    first = cut_lineage(best(searched(asked.withColumn("floor", F.lit(float("-inf"))), False), k))
    floors = first.where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("floor"))
    second = searched(asked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), True)
    return best(first.drop("rank").unionByName(second), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
