"""SimHash near-duplicate detection with vantage-point trees.

Every whole text gets a 64-bit SimHash of its word shingles.  Documents are first aggregated to distinct
fingerprints, so a group of copies is one row however large it is.

In 64 bits a ring around a vantage point excludes little: nearly all distances lie within the radius of the
median.  So there is one tree for each third of the bits: of two fingerprints within 4 bits one third at
least differs in 1 bit at most, and a ball of radius 1 meets few shards.  A tree, built from a bounded sample,
cuts its third's values by their Hamming distance to vantage points; a fingerprint is at home in one
shard, and by the triangle inequality it also visits those whose ring its ball overlaps, as a query.  Inside a
shard a second tree over the distinct values of the third finds the close ones, and the fingerprints behind them are
compared in full, so the result is exact.  A ball of radius 1 holds one of 10^5 values of a third, so of 10^9 random
fingerprints each is compared in full with about 3 * 10^4.  A task emits spanning links instead of all pairs; a dense
group of values is linked through stars (points within the radius of one centre need no comparison with each
other).  The links of all shards are joined into components by distributed min-label contraction.

Hot shards: the rows of one are dealt to blocks of about BLOCK rows by hash, and every pair of blocks is a task, so a
dense region is spread and no task's rows grow with the table.  Hubs of links, large components and large groups of
copies never meet in one task either (common.join_sized).

Defined results: a null text counts as empty; an empty text has fingerprint zero, which links like any other;
a text shorter than a shingle is one shingle; null doc_ids form rows of their own and never name a component
(a component of null ids only has a null id); repeated rows are kept; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_sized

#: Fingerprints in the sample from which the sharding tree is built: the bound of what reaches the driver.
SAMPLE = 1 << 13
#: Parts of a fingerprint that have a tree each; depths of the trees: the least one holds up to 2^DEPTH_ROWS fingerprints, each doubling adds one.
PARTS, MIN_DEPTH, MAX_DEPTH, DEPTH_ROWS = 3, 6, 12, 24
#: Rows of a shard in a block; candidate pairs compared at a time.
BLOCK, CHUNK = 1 << 16, 1 << 21


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole text; see the module for short and empty ones."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: -shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        h = np.array(hashes[at : at + (1 << 16)], np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every document, in one map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def hamming(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Vantage point and median ring of each inner node, in heap order (children of k: 2k+1 near, 2k+2 far)."""
    nodes: list[tuple[int, int]] = []
    parts = [np.unique(sample)]
    for _ in range(depth):
        below = []
        for part in parts:
            vantage = part[0] if len(part) else np.uint64(0)
            d = hamming(part, vantage)
            # of a few sample points the one whose distances spread most prunes best
            for other in part[:: max(1, len(part) // 8)][:8]:
                e = hamming(part, other)
                if len(e) and e.std() > d.std():
                    vantage, d = other, e
            ring = int(np.median(d)) if len(d) else 32
            nodes.append((int(vantage), ring))
            below += [part[d <= ring], part[d > ring]]
        parts = below
    return nodes


def route(fp: np.ndarray, nodes: list[tuple[int, int]], depth: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the fingerprint, shard, and whether it is at home there, for every shard that its ball meets."""
    who, node, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
    vantage, rings = np.array([n[0] for n in nodes], np.uint64), np.array([n[1] for n in nodes], np.int64)
    for _ in range(depth):
        d = hamming(fp[who], vantage[node]).astype(np.int64)
        ring = rings[node]
        near, far = d - radius <= ring, d + radius > ring
        inside = d <= ring
        who, home, node = (
            np.concatenate([who[near], who[far]]),
            np.concatenate([home[near] & inside[near], home[far] & ~inside[far]]),
            np.concatenate([2 * node[near] + 1, 2 * node[far] + 2]),
        )
    return who, node - (2**depth - 1), home


def close_values(own: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the radius between two arrays of distinct values, exactly.

    A local vantage-point tree halves both sides until a node is small; the other side keeps what the triangle
    inequality cannot exclude.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stack = [(np.arange(len(own)), np.arange(len(other)), 0)]
    while stack:
        a, b, level = stack.pop()
        if len(a) and len(b):
            vantage = own[a[len(a) // 2]]
            d = hamming(own[a], vantage).astype(np.int64)
            ring = int(np.median(d))
            inside = d <= ring
            if len(a) > 64 and level < 12 and not inside.all():
                e = hamming(other[b], vantage).astype(np.int64)
                stack += [(a[inside], b[e - radius <= ring], level + 1), (a[~inside], b[e + radius > ring], level + 1)]
                continue
            x, y = np.nonzero(hamming(own[a, None], other[None, b]) <= radius)
            left.append(a[x])
            right.append(b[y])
    return np.concatenate(left), np.concatenate(right)


def star_links(points: np.ndarray, radius: int, distance: Callable = hamming) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links that connect whatever pairs within the radius connect, without comparing all pairs.

    Every centre is compared with all points, and what is within its radius belongs to its star.  Two stars that
    no link joins yet are compared member by member if their centres are within three radii of each other.
    """
    star, centres, parent = np.full(len(points), -1), [], []
    left, right = [], []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for c in range(len(points)):
        if star[c] >= 0:
            continue
        near = np.flatnonzero(distance(points, points[c]) <= radius)
        k = len(centres)
        centres.append(c)
        parent.append(k)
        for j in np.unique(star[near]).tolist():
            if j >= 0:
                parent[find(j)] = find(k)
        star[near[star[near] < 0]] = k
        left.append(np.full(len(near), c))
        right.append(near)
    members = np.split(np.argsort(star, kind="stable"), np.cumsum(np.bincount(star))[:-1])
    for j, c in enumerate(centres):
        reach = np.flatnonzero(distance(points[centres[j + 1 :]], points[c]) <= 3 * radius) + j + 1
        for k in reach.tolist():
            if find(j) != find(k):
                step = max(1, CHUNK // len(members[k]))
                for at in range(0, len(members[j]), step):
                    x, y = np.nonzero(distance(points[members[j][at : at + step], None], points[None, members[k]]) <= radius)
                    if len(x):
                        left.append(members[j][at + x[:1]])
                        right.append(members[k][y[:1]])
                        parent[find(j)] = find(k)
                        break
    return np.concatenate(left), np.concatenate(right)


def close_links(own: np.ndarray, every: np.ndarray, part: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `every` (which begins with `own`) of links that connect all pairs of an own row and any row within the radius.

    Only pairs that are close in the given part are looked at.
    """
    a_order, b_order = np.argsort(piece(own, part), kind="stable"), np.argsort(piece(every, part), kind="stable")
    a_values, a_start, a_count = np.unique(piece(own, part)[a_order], return_index=True, return_counts=True)
    b_values, b_start, b_count = np.unique(piece(every, part)[b_order], return_index=True, return_counts=True)
    i, j = close_values(a_values, b_values, radius // PARTS)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    work = a_count[i] * b_count[j]
    for k in np.flatnonzero(work > CHUNK).tolist():
        both = np.unique(np.concatenate([a_order[a_start[i[k]] :][: a_count[i[k]]], b_order[b_start[j[k]] :][: b_count[j[k]]]]))
        x, y = star_links(every[both], radius)
        left.append(both[x])
        right.append(both[y])
    i, j, work = i[work <= CHUNK], j[work <= CHUNK], work[work <= CHUNK]
    cuts = np.searchsorted(np.cumsum(work), np.arange(CHUNK, work.sum() + CHUNK, CHUNK))
    for at, to in zip([0, *(cuts[:-1] + 1)], cuts + 1, strict=True) if len(work) else ():
        n = work[at:to]
        pair = np.repeat(np.arange(at, min(to, len(work))), n)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        width = b_count[j[pair]]
        x, y = a_order[a_start[i[pair]] + within // width], b_order[b_start[j[pair]] + within % width]
        near = hamming(own[x], every[y]) <= radius
        left.append(x[near])
        right.append(y[near])
    return np.concatenate(left), np.concatenate(right)


def spanning_links(fp: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the least one of its component, from positions of linked pairs."""
    order = np.argsort(fp)
    label = np.empty(len(fp), np.int64)
    label[order] = np.arange(len(fp))  # ranks: hooking to the least rank
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    root = fp[order[label]]
    moved = root != fp
    return fp[moved], root[moved]


def piece(fp: np.ndarray, part: int, parts: int = PARTS) -> np.ndarray:
    """Bits of one part of the fingerprints, which are cut into parts of nearly equal width."""
    low, high = 64 * part // parts, 64 * (part + 1) // parts
    return (fp >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)


def pairs_of_blocks(cell: np.ndarray, key: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and second block of every task that a row of a cell takes part in; rows are dealt to blocks by key."""
    times = blocks[cell]
    row = np.repeat(np.arange(len(cell)), times)
    other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    mixed = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
    mine = (mixed % np.maximum(1, times))[row]
    return row, np.minimum(mine, other), np.maximum(mine, other)


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Spanning links (a, b) of all pairs of distinct fingerprints within the radius."""
    n = distinct.count()
    depth = min(MAX_DEPTH, MIN_DEPTH + max(0, (max(n, 1) - 1).bit_length() - DEPTH_ROWS))
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    trees = [build_tree(piece(sample, part), depth) for part in range(PARTS)]

    def members(fp: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index, shard and home mark of every fingerprint that a shard holds: at home, or as a query from an earlier shard."""
        who, shard, home = route(piece(fp, part), trees[part], depth, radius // PARTS)
        own = np.zeros(len(fp), np.int64)
        own[who[home]] = shard[home]
        keep = shard >= own[who]
        return who[keep], shard[keep], home[keep]

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(PARTS << depth, np.int64)
        for frame in frames:
            fp = frame["fp"].to_numpy().view(np.uint64)
            for part in range(PARTS):
                held += np.bincount((part << depth) + members(fp, part)[1], minlength=len(held))
        yield pd.DataFrame({"cell": np.flatnonzero(held), "n": held[held > 0]})

    counted = distinct.select("fp").mapInPandas(sizes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # PARTS * 2^depth rows at most
    blocks = np.ones(PARTS << depth, np.int64)
    for r in counted:
        blocks[r.cell] = -(-r.n // BLOCK)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["fp"].to_numpy().view(np.uint64)
            for part in range(PARTS):
                who, shard, home = members(fp, part)
                row, i, j = pairs_of_blocks((part << depth) + shard, fp[who], blocks)
                yield pd.DataFrame({"part": np.full(len(row), part), "shard": shard[row], "i": i, "j": j, "fp": fp[who[row]].view(np.int64), "home": home[row]})

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        fp, home = frame["fp"].to_numpy().view(np.uint64), frame["home"].to_numpy()
        own, every = fp[home], np.concatenate([fp[home], fp[~home]])
        x, y = close_links(own, every, int(frame["part"].iloc[0]), radius)
        a, b = spanning_links(every, x, y)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = distinct.select("fp").mapInPandas(send, "part long, shard long, i long, j long, fp long, home boolean")
    return cut_lineage(sent.groupBy("part", "shard", "i", "j").applyInPandas(compare, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) for every node of the links, by large-star and small-star rounds.

    Each round is two aggregations and joins over the links alone; rounds end when nothing changes.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    edges, before = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), None
    while (now := mark(edges)) != before and now[0]:
        before = now
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = cut_lineage(join_sized(both, least, "u", 2 * now[0]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        kept = join_sized(large, least, "a", now[0])
        edges = cut_lineage(kept.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    marked = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    tree = components(links(distinct, radius))
    rooted = cut_lineage(distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.col("n").alias("copies"), F.coalesce("root", "fp").alias("root")))
    named = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    class_of = cut_lineage(join_sized(rooted, named, "root", rooted.count()).select("fp", "component_id", F.col("copies").alias("n")))
    return join_sized(marked, class_of, "fp", marked.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
