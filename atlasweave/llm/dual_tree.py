"""Exact k-means (Lloyd) with a cover tree over the vectors and, in each round, a tree over the centroids.

Vectors are cut into blocks where they are.  A block's cover tree is built once: its centres come in farthest-first order, so the centres of
level i (those that were more than 2^i away from all before) are more than 2^i from each other and within 2^i of all vectors;
the finest level has one centre for LEAF vectors at most, and its centres' nearest vectors are the leaves.  A node stores its radius, its number of
vectors and their sum.  Trees are written to the shared folder and stay the same in all rounds.

A round walks both trees level by level: a pair of a vector node and a centroid node is dropped where the least distance between their
balls exceeds the greatest distance to some centroid.  A node that one centroid is left for adds its stored sum at once; in leaves
the vectors are compared exactly with the centroids that are left.  Every task gives one row a block and cluster, which Spark sums up; the
driver gets one row a cluster.

Defined results: vectors that are null, have another number of components, or hold a null or non-finite one take no part.  A null id can't start a
centroid, but its vector is clustered; equal ids are ordered by their components; with fewer vectors than centroids there are fewer centroids; an
empty table gives an empty result; other columns are ignored.  Scaled components beyond 64 bits count as a 64-bit number near the limit; sums
and comparisons are exact at any size, and a distance or inertia beyond 64 bits is null, as is an inertia with such a distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Vectors of a block, and vectors for each centre of the finest level on average at least.
BLOCK, LEAF = 1 << 12, 1 << 4
#: Components below this stay exact in 64 bits through sums of squares; others are computed as Python's integers.
EXACT = 1 << 25
TREE = "ids array<long>, vectors binary, wide boolean, centre binary, radius binary, low binary, high binary, parent binary, sums binary"


@dataclass
class Tree:
    """A cover tree: the vectors in the order of its walk, and for each node, parents first, what belongs to it.

    centre is the place of its central vector, low..high are the places of its vectors, sums their sum (none for wide vectors).
    """

    vectors: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parent: np.ndarray
    sums: np.ndarray | None


def rounding(*squares: np.ndarray) -> float:
    """More than the error of a distance that is computed from squared lengths and inner products."""
    return 1e-6 * float(np.sqrt(sum(s.max(initial=0) for s in squares) + 1))


def farthest_first(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres in farthest-first order, each one's distance to those before it, and every vector's nearest centre (by its number)."""
    length = (v * v).sum(1)
    error = rounding(length, length)

    def away(k: int) -> np.ndarray:
        d = np.sqrt(np.maximum(0, length + length[k] - 2 * (v @ v[k])))
        d[(d < error) | (np.arange(len(v)) == k)] = 0
        return d

    centres, gaps, owner = [int(((v - v.mean(0)) ** 2).sum(1).argmin())], [np.inf], np.zeros(len(v), np.int64)
    near = away(centres[0])
    while len(centres) < most and near.max() > 0:
        far = int(near.argmax())
        gaps.append(float(near[far]))
        d = away(far)
        owner[d < near] = len(centres)
        near = np.minimum(near, d)
        centres.append(far)
    return np.array(centres), np.array(gaps), owner


def cover_tree(vectors: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The cover tree of a block of integer vectors, and the order that its vectors are in."""
    v = vectors.astype(np.float64)
    centres, gaps, owner = farthest_first(v, max(1, len(v) // leaf))
    # the level that a centre first stands in: the greatest i with gap > 2^i; its parent is the nearest centre of a coarser level
    level = np.array([2000.0, *np.ceil(np.log2(gaps[1:])) - 1])
    kids: list[list[int]] = [[] for _ in centres]
    for k in range(1, len(centres)):
        older = np.flatnonzero(level[:k] > level[k])
        kids[older[((v[centres[older]] - v[centres[k]]) ** 2).sum(1).argmin()]].append(k)
    members = np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner, minlength=len(centres)))[:-1])
    # a walk puts each subtree's vectors together; a centre with others below it has a leaf of its own vectors, too
    order, nodes, at, stack = [], [], 0, [(0, -1)]
    while stack:
        k, above = stack.pop()
        if k < 0:  # all below node `above` have been seen
            nodes[above][2] = at
            continue
        me = len(nodes)
        nodes.append([centres[k], at, at + len(members[k]), above])
        order.append(members[k])
        if kids[k]:
            nodes.append([centres[k], at, at + len(members[k]), me])
            stack += [(-1, me), *((c, me) for c in kids[k])]
        at += len(members[k])
    order = np.concatenate(order)
    place = np.empty(len(v), np.int64)
    place[order] = np.arange(len(v))
    centre, low, high, parent = np.array(nodes).T
    own, kept = v[order], vectors[order]
    radius = np.array([np.sqrt(((own[a:b] - v[c]) ** 2).sum(1).max()) for c, a, b in zip(centre, low, high, strict=True)])
    wide = bool((np.abs(v) >= EXACT).any())
    before = np.concatenate([np.zeros((1, v.shape[1]), np.int64), np.cumsum(kept, 0)]) if not wide else None
    return Tree(kept, place[centre], radius, low, high, parent, None if wide else before[high] - before[low]), order


@dataclass
class Balls:
    """A binary tree over centroids, parents first: centre, radius, parent and covers (node by centroid); leaf is the node of each centroid."""

    centre: np.ndarray
    radius: np.ndarray
    parent: np.ndarray
    covers: np.ndarray
    leaf: np.ndarray


def centroid_tree(centroids: np.ndarray) -> Balls:
    """Groups are split between two centroids that are far from each other; equal ones by half."""
    c = centroids.astype(np.float64)
    rows, queue = [], [(np.arange(len(c)), -1)]
    for group, above in queue:
        middle = c[group].mean(0)
        rows.append((middle, float(np.sqrt(((c[group] - middle) ** 2).sum(1).max())), above, np.isin(np.arange(len(c)), group)))
        if len(group) > 1:
            far = group[((c[group] - middle) ** 2).sum(1).argmax()]
            other = group[((c[group] - c[far]) ** 2).sum(1).argmax()]
            first = ((c[group] - c[far]) ** 2).sum(1) < ((c[group] - c[other]) ** 2).sum(1)
            first = first if first.any() else np.arange(len(group)) < len(group) // 2
            queue += [(group[first], len(rows) - 1), (group[~first], len(rows) - 1)]
    centre, radius, parent, covers = (np.array(x) for x in zip(*rows, strict=True))
    single = np.flatnonzero(covers.sum(1) == 1)
    leaf = np.empty(len(c), np.int64)
    leaf[covers[single].argmax(1)] = single
    return Balls(centre, radius, parent, covers, leaf)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: in floats where all sums fit 53 bits, else in integers, of any size if need be."""
    most = max(abs(int(x)) for m in (a, b) for x in (m.min(initial=0), m.max(initial=0)))
    kind = np.float64 if 4 * most * most * a.shape[1] < 2**53 else np.int64 if most < EXACT else object
    x, y = a.astype(kind), b.astype(kind)
    found = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
    return found.astype(np.int64) if kind is np.float64 else found


def walk(tree: Tree, balls: Balls) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]], int]:
    """(node, centroid) for nodes with one centroid left, (leaf, centroids left) for others, and how many pairs of nodes were visited."""
    points = tree.vectors[tree.centre].astype(np.float64)
    p, m = (points**2).sum(1), (balls.centre**2).sum(1)
    away, error = np.sqrt(np.maximum(0, p[:, None] + m[None] - 2 * points @ balls.centre.T)), rounding(p, m)
    reach = away[:, balls.leaf].min(1) + tree.radius + 2 * error  # no vector of the node is farther from its nearest centroid
    far = away - tree.radius[:, None] - balls.radius[None] - 2 * error > reach[:, None]
    below = np.argsort(tree.parent, kind="stable")
    begin, end = (np.searchsorted(tree.parent[below], np.arange(len(points)), side) for side in ("left", "right"))
    frontier, left, pairs, owned, compared = np.array([0]), np.ones((1, len(balls.leaf)), bool), 0, [], []
    while len(frontier):
        held = left @ balls.covers.T
        opened = np.zeros(held.shape, bool)
        for ball, above in enumerate(balls.parent.tolist()):
            visited = held[:, ball] & opened[:, above] if above >= 0 else held[:, ball]
            pairs += int(visited.sum())
            opened[:, ball] = visited & ~far[frontier, ball]
        left = opened[:, balls.leaf]
        one, ends = left.sum(1) == 1, begin[frontier] == end[frontier]
        owned += zip(frontier[one].tolist(), left[one].argmax(1).tolist(), strict=True)
        compared += [(int(k), np.flatnonzero(row)) for k, row in zip(frontier[ends & ~one], left[ends & ~one], strict=True)]
        inner = ~one & ~ends
        kids = [below[begin[k] : end[k]] for k in frontier[inner]]
        left = np.repeat(left[inner], [len(k) for k in kids], 0)
        frontier = np.concatenate(kids) if kids else np.zeros(0, np.int64)
    return owned, compared, pairs


def assign(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], int, int]:
    """The nearest centroid of each vector (ties: the smaller number), the nodes owned whole, and how many pairs of nodes and exact distances it took."""
    owned, compared, pairs = walk(tree, centroid_tree(centroids))
    found, exact = np.zeros(len(tree.vectors), np.int64), 0
    for node, c in owned:
        found[tree.low[node] : tree.high[node]] = c
    for node, left in compared:
        a, b = tree.low[node], tree.high[node]
        found[a:b] = left[squared(tree.vectors[a:b], centroids[left]).argmin(1)]
        exact += int(b - a) * len(left)
    return found, owned, pairs, exact


def sums_of(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[int, int, np.ndarray]], int, int]:
    """(centroid, number of vectors, their sum) of a block, and what it took; owned nodes add their stored sums."""
    found, owned, pairs, exact = assign(tree, centroids)
    totals = [np.zeros(tree.vectors.shape[1], object) for _ in centroids]
    rest = np.ones(len(found), bool)
    if tree.sums is not None:
        for node, c in owned:
            totals[c] += tree.sums[node].astype(object)
            rest[tree.low[node] : tree.high[node]] = False
    for c in np.unique(found[rest]).tolist():
        chosen = tree.vectors[rest & (found == c)]
        totals[c] += (chosen.astype(object) if tree.sums is None else chosen).sum(0).astype(object)
    n = np.bincount(found, minlength=len(centroids)).tolist()
    return [(c, n[c], totals[c]) for c in range(len(n)) if n[c]], pairs, exact


def kept_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (longs) of the vectors that take part."""
    v = F.col(vector_col)
    usable = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024)))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))


def trees(vectors: DataFrame, dims: int) -> DataFrame:
    """One row for each block of vectors(vec_id, v): its cover tree."""

    def block(ids: list, rows: list[np.ndarray]) -> pa.RecordBatch:
        tree, order = cover_tree(np.concatenate(rows))
        wide = tree.sums is None
        arrays = [tree.vectors.astype("<i8" if wide else "<i4"), tree.centre.astype("<i8"), tree.radius.astype("<f8"), tree.low.astype("<i8"), tree.high.astype("<i8"), tree.parent.astype("<i8"), np.zeros(0) if wide else tree.sums.astype("<i8")]
        first, *others = (pa.array([a.tobytes()], pa.binary()) for a in arrays)
        return pa.RecordBatch.from_arrays([pa.array([[ids[k] for k in order]], pa.list_(pa.int64())), first, pa.array([wide]), *others], ["ids", "vectors", "wide", "centre", "radius", "low", "high", "parent", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                piece = batch.slice(at, BLOCK)
                ids += piece.column(0).to_pylist()
                rows.append(piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims))
                held += len(piece)
                if held >= BLOCK:
                    yield block(ids, rows)
                    ids, rows, held = [], [], 0
        if held:
            yield block(ids, rows)

    return vectors.select("vec_id", "v").mapInArrow(run, TREE)


def opened(batch: pa.RecordBatch, row: int, dims: int) -> tuple[pa.Array, Tree]:
    """The ids and the tree of a row of trees()."""
    get = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)
    wide = batch.column("wide")[row].as_py()
    v = get("vectors", "<i8" if wide else "<i4").astype(np.int64).reshape(-1, dims)
    return batch.column("ids")[row].values, Tree(v, *(get(c, "<f8" if c == "radius" else "<i8") for c in ("centre", "radius", "low", "high", "parent")), None if wide else get("sums", "<i8").reshape(-1, dims))


def one_round(blocks: DataFrame, centroids: np.ndarray) -> tuple[dict[int, tuple[int, list[int]]], int, int]:
    """Number and sum of every centroid's vectors, and how many pairs of nodes and exact distances it took."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                found, pairs, exact = sums_of(opened(batch, row, dims)[1], centroids)
                cost = [(pairs, exact), *[(0, 0)] * len(found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([[Decimal(int(x)) for x in f[2]] for f in found], pa.list_(pa.decimal128(38, 0))), pa.array([c[0] for c in cost[: len(found)]], pa.int64()), pa.array([c[1] for c in cost[: len(found)]], pa.int64())],
                    ["cluster", "n", "s", "pairs", "exact"],
                )

    parts = blocks.mapInArrow(run, "cluster int, n long, s array<decimal(38,0)>, pairs long, exact long")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs"), F.sum("exact").alias("exact"), *[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(dims)]).collect()
    return {r.cluster: (r.n, [int(r[f"s{k}"]) for k in range(dims)]) for r in rows}, sum(r.pairs for r in rows), sum(r.exact for r in rows)


@dataclass
class Clusters:
    """The blocks, the final centroids, and for each round how many pairs of nodes were visited and vectors compared exactly with a centroid."""

    blocks: DataFrame
    centroids: np.ndarray
    visits: list[tuple[int, int]]


def start(vectors: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors whose ids have the least hashes, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").orderBy(order, "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, dims)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """Lloyd's rounds; they end early where no centroid moves, as nothing would change any more."""
    usable = kept_vectors(vectors, dims, scale, id_col, vector_col)
    centroids, visits = start(usable, k, seed, dims), []
    blocks = cut_lineage(trees(usable, dims))
    for _ in range(rounds if len(centroids) else 0):
        found, pairs, exact = one_round(blocks, centroids)
        visits.append((pairs, exact))
        moved = np.array([[s // found[c][0] for s in found[c][1]] if c in found else row.tolist() for c, row in enumerate(centroids)], np.int64)
        if (moved == centroids).all():
            break
        centroids = moved
    return Clusters(blocks, centroids, visits)


def members(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector."""
    centroids = found.centroids
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids, tree = opened(batch, row, dims)
                chosen = assign(tree, centroids)[0]
                distance = [0] * len(chosen)
                for c in np.unique(chosen).tolist():
                    at = np.flatnonzero(chosen == c)
                    for i, d in zip(at.tolist(), squared(tree.vectors[at], centroids[c : c + 1])[:, 0].tolist(), strict=True):
                        distance[i] = int(d) if d < 2**63 else None
                yield pa.RecordBatch.from_arrays([ids, pa.array(chosen, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "d"])

    if not len(centroids):
        nothing = F.lit(None).cast("long")
        rows = found.blocks.select(F.explode("ids").alias("vec_id")).limit(0)
        return rows.select("vec_id", F.lit(0).alias("cluster"), nothing.alias("distance"), nothing.alias("cluster_inertia"), nothing.alias("inertia"), F.lit("").alias("centroid_sha256"))
    rows = cut_lineage(found.blocks.mapInArrow(run, "vec_id long, cluster int, d long"))
    summed = lambda n, d: F.when(F.count("*") == F.count(d), F.sum(F.col(d).cast("decimal(38,0)"))).alias(n)
    totals = rows.groupBy("cluster").agg(summed("s", "d"))
    whole = totals.agg(summed("whole", "s"))
    names = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()])
    out = rows.join(F.broadcast(totals), "cluster").join(F.broadcast(whole))  # a row a cluster, and one row
    return out.select("vec_id", "cluster", F.col("d").alias("distance"), F.col("s").try_cast("long").alias("cluster_inertia"), F.col("whole").try_cast("long").alias("inertia"), names[F.col("cluster")].alias("centroid_sha256"))
