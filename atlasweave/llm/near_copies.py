"""Near copies by exact shingle similarity, with SimHash and vantage-point trees for the candidates.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more; a text
shorter than a shingle is one shingle.  At 0.8 about a seventh of all SimHash bits differ, so 4 of 64 bits find
little.  Every distinct text gets a 256-bit SimHash of its set of shingles: sixteen parts of 16 bits, each with a
vantage-point tree and radius 1.  At 0.8 a pair agrees so far in one part at least with a chance of 0.994 by
calculation (more above 0.8); pairs that also lie within RADIUS of all 256 bits are candidates.

Candidates only propose: inside each group that they connect, shingle sets are compared exactly, breadth first, until
no unreached text is similar to a reached one, so a group has links that connect all its similar pairs and no others.
A large group is cut into blocks: what few texts of the group connect isn't compared again, the rest is compared with every block.

Defined results: null counts as empty; an empty text has no shingle and is only a copy of empty texts; case (A-Z) and
white space make no difference; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut_lineage, join_sized, own, sized

#: Words of a shingle; least Jaccard similarity in thousandths.
SHINGLE, SIMILAR = 5, 800
#: 64-bit words of a fingerprint and their 16-bit parts; distances of candidates in all bits, in one word and in one part.
WORDS, PARTS, RADIUS, WORD_RADIUS, PART_RADIUS = 4, 16, 60, 22, 1
#: Texts of a candidate group that one task holds of each block, and their bytes; groups up to SMALL texts share tasks.
BLOCK, BYTES, SMALL = 2048, 1 << 25, 64
#: Links whose components one task finds (16 bytes each); more are joined in rounds.
LINKS = 1 << 20
#: Texts of a large group that every block of it is compared with first.
MODELS = 4
COLUMNS = [f"w{k}" for k in range(WORDS)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits from a set of shingle hashes; each word takes another mix of the hashes."""
    out = np.zeros(WORDS, np.uint64)
    for k in range(WORDS):
        bits = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 15):
            h = hashes[at : at + (1 << 15)] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[k] = np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0]
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits over all words (the last axis)."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def part_of(fp: np.ndarray, part: int) -> np.ndarray:
    return simhash.piece(fp[:, part // 4], part % 4, 4)


def marks(docs: DataFrame, names: list[str], id_col: str, text_col: str) -> DataFrame:
    """file and row (the row's name), doc_id, body (equal for equal words) and the fingerprint's words, in one map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            body, fp = np.zeros(len(batch), np.uint64), np.zeros((len(batch), WORDS), np.uint64)
            for k, text in enumerate(batch.column(3)):  # one text's words at a time
                words = words_of(text.as_py())
                body[k], fp[k] = xxhash.xxh64_intdigest(b" ".join(words), 7), fingerprint(shingles(words))
            body, fp = body.view(np.int64), fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(body), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(WORDS))], ["file", "row", "doc_id", "body", *COLUMNS])

    rows = docs.select(*(own(docs, c).alias(a) for c, a in zip(names, ("file", "row"), strict=True)), own(docs, id_col).cast("long").alias("doc_id"), own(docs, text_col).alias("text"))
    return rows.mapInArrow(run, "file long, row long, doc_id long, body long, " + ", ".join(f"{c} long" for c in COLUMNS))


def close_rows(own: np.ndarray, every: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `every` (which begins with `own`) of links that connect all candidates that are close in the part."""
    a_order, b_order = np.argsort(part_of(own, part), kind="stable"), np.argsort(part_of(every, part), kind="stable")
    a_values, a_start, a_count = np.unique(part_of(own, part)[a_order], return_index=True, return_counts=True)
    b_values, b_start, b_count = np.unique(part_of(every, part)[b_order], return_index=True, return_counts=True)
    i, j = simhash.close_values(a_values, b_values, PART_RADIUS)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    chunk = simhash.CHUNK // WORDS
    work = a_count[i] * b_count[j]
    for k in np.flatnonzero(work > chunk).tolist():
        both = np.unique(np.concatenate([a_order[a_start[i[k]] :][: a_count[i[k]]], b_order[b_start[j[k]] :][: b_count[j[k]]]]))
        x, y = simhash.star_links(every[both], RADIUS, distance)
        left.append(both[x])
        right.append(both[y])
    i, j, work = i[work <= chunk], j[work <= chunk], work[work <= chunk]
    at, total = 0, np.cumsum(work)
    while at < len(work):
        to = max(at + 1, int(np.searchsorted(total, total[at] - work[at] + chunk, "right")))
        n = work[at:to]
        pair = np.repeat(np.arange(at, to), n)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        width = b_count[j[pair]]
        x, y = a_order[a_start[i[pair]] + within // width], b_order[b_start[j[pair]] + within % width]
        # one word first: it rules out nearly all pairs
        near = simhash.hamming(own[x, 0], every[y, 0]) <= WORD_RADIUS
        x, y = x[near], y[near]
        near = distance(own[x], every[y]) <= RADIUS
        left.append(x[near])
        right.append(y[near])
        at = to
    return np.concatenate(left), np.concatenate(right)


def candidates(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between bodies that connect all candidates; distinct has body and the fingerprint's words."""
    n = distinct.count()
    depth = min(simhash.MAX_DEPTH, simhash.MIN_DEPTH + max(0, (max(n, 1) - 1).bit_length() - simhash.DEPTH_ROWS))
    rows = distinct.orderBy(F.xxhash64("body"), "body").limit(simhash.SAMPLE).select(*COLUMNS).collect()
    sample = np.array([tuple(r) for r in rows], np.int64).reshape(-1, WORDS).view(np.uint64)
    trees = [simhash.build_tree(part_of(sample, part), depth) for part in range(PARTS)]

    def words(frame: pd.DataFrame) -> np.ndarray:
        return np.ascontiguousarray(frame[COLUMNS].to_numpy(np.int64)).view(np.uint64)

    def members(fp: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As in simhash.links: index, shard and home mark."""
        who, shard, home = simhash.route(part_of(fp, part), trees[part], depth, PART_RADIUS)
        own = np.zeros(len(fp), np.int64)
        own[who[home]] = shard[home]
        keep = shard >= own[who]
        return who[keep], shard[keep], home[keep]

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(PARTS << depth, np.int64)
        for frame in frames:
            fp = words(frame)
            for part in range(PARTS):
                held += np.bincount((part << depth) + members(fp, part)[1], minlength=len(held))
        yield pd.DataFrame({"cell": np.flatnonzero(held), "n": held[held > 0]})

    counted = distinct.mapInPandas(sizes, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # PARTS * 2^depth rows at most
    blocks = np.ones(PARTS << depth, np.int64)
    for r in counted:
        blocks[r.cell] = -(-r.n // simhash.BLOCK)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp, body = words(frame), frame["body"].to_numpy()
            for part in range(PARTS):
                who, shard, home = members(fp, part)
                row, i, j = simhash.pairs_of_blocks((part << depth) + shard, body[who], blocks)
                out = {"part": np.full(len(row), part), "shard": shard[row], "i": i, "j": j, "body": body[who[row]], "home": home[row]}
                yield pd.DataFrame(out | {c: fp[who[row], k].view(np.int64) for k, c in enumerate(COLUMNS)})

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = pd.concat([frame[frame["home"]], frame[~frame["home"]]])
        fp, body = words(frame), frame["body"].to_numpy()
        x, y = close_rows(fp[: int(frame["home"].sum())], fp, int(frame["part"].iloc[0]))
        a, b = simhash.spanning_links(body, x, y)
        return pd.DataFrame({"a": a, "b": b})

    fields = ", ".join(f"{c} long" for c in COLUMNS)
    sent = distinct.mapInPandas(send, f"part long, shard long, i long, j long, body long, home boolean, {fields}")
    return cut_lineage(sent.groupBy("part", "shard", "i", "j").applyInPandas(compare, "a long, b long").distinct())


def similar_links(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Positions of links between similar sets that connect whatever similar pairs connect; every link is similar."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    unreached, left, right = np.ones(len(sets), bool), [], []
    for seed in range(len(sets)):
        if not unreached[seed]:
            continue
        unreached[seed] = False
        todo = [seed]
        while todo and unreached.any():
            c = todo.pop()
            if not sizes[c]:
                continue
            keep = unreached[owner]
            flat, owner = flat[keep], owner[keep]
            at = np.minimum(np.searchsorted(sets[c], flat), sizes[c] - 1)
            common = np.bincount(owner[sets[c][at] == flat], minlength=len(sets))
            near = np.flatnonzero(unreached & (1000 * common >= SIMILAR * (sizes[c] + sizes - common)))
            unreached[near] = False
            todo += near.tolist()
            left += [c] * len(near)
            right += near.tolist()
    return left, right


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links that isn't the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y, before = label[u], label[v], label.copy()
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]


def components(links: DataFrame) -> DataFrame:
    """node and root for every node of links(a, b) that isn't its component's least: by one task if they are LINKS at most, else by rounds."""
    links = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    if links.count() > LINKS:
        return simhash.components(links)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [f.to_numpy(np.int64) for f in frames]
        if every:
            pairs = np.concatenate(every)
            node, root = local_components(pairs[:, 0], pairs[:, 1])
            yield pd.DataFrame({"node": node, "root": root})

    return cut_lineage(links.coalesce(1).mapInPandas(run, "node long, root long"))


def compare(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of similar texts within each candidate group of a task."""
    a, b = [], []
    for _, group in frame.groupby("root", sort=False):
        body = group["body"].to_numpy()
        x, y = similar_links([shingles(words_of(t)) for t in group["text"]])
        a += body[x].tolist()
        b += body[y].tolist()
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


LINK = "a long, b long"


def verified(members: DataFrame) -> DataFrame:
    """Links (a, b) of similar bodies; members has root (the candidate group), body and text.

    Groups of one block are compared at once.  In a larger one each block is first compared within itself and with MODELS texts of the group, which
    connects nearly all of it; then only the texts outside of the group's largest connected part are compared with the others, so a text is
    sent once and again for each block of those, not for each block of the group.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    cut = lambda n, nbytes: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(nbytes) / BYTES)).cast("int")
    held = cut_lineage(members.groupBy("root").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).withColumn("blocks", cut("n", "bytes")))
    total = held.agg(F.sum("n"), F.sum("bytes"), F.max("blocks")).first()
    tasks = 1 + (total[1] or 0) // BYTES
    rows = join_sized(members, held.select("root", "blocks", (F.col("n") <= SMALL).alias("few"), "n"), "root", total[0] or 0)
    task = F.when(F.col("few"), F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.col("root"))
    links = cut_lineage(rows.where("blocks = 1").select(task.alias("task"), "few", "root", "body", "text").groupBy("task", "few").applyInPandas(compare, LINK))
    return links if (total[2] or 1) == 1 else links.union(_large(cut_lineage(rows.where("blocks > 1").drop("few", "n"))))


def _large(rows: DataFrame) -> DataFrame:
    """Links within groups of several blocks; rows has root, body, text and blocks."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("body"), F.col("blocks")).cast("int"))
    by_hash = F.min(F.struct(F.xxhash64("body", F.lit(1)), "body"))
    models = sized(rows.groupBy("root", F.pmod(F.xxhash64("body", F.lit(2)), F.lit(MODELS))).agg(by_hash.alias("m")).select("root", "m.body"))
    spread = rows.join(models, ["root", "body"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
    key = ["root", "block"]
    first = rows.select(*key, "body", "text").union(spread.select("root", F.col("other").alias("block"), "body", "text"))
    links = cut_lineage(first.groupBy(*key).applyInPandas(compare, LINK).distinct())
    # what stands outside of the largest connected part of its group
    part = components(links).toDF("body", "part")
    placed = cut_lineage(rows.select("root", "body", "block", "blocks", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).join(part, "body", "left").withColumn("part", F.coalesce("part", "body")))
    parts = placed.groupBy("root", "part").agg(F.count("*").alias("n"))
    main = parts.groupBy("root").agg(F.max(F.struct("n", "part")).alias("x")).select("root", F.col("x.part").alias("main"))
    outside = cut_lineage(placed.join(sized(main), "root").where("part <> main").select("root", "body", "bytes", "block", "blocks"))
    some = cut_lineage(outside.groupBy("root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).select("root", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BYTES)).cast("int").alias("cuts")))
    if some.isEmpty():
        return links
    # blocks of those outside, numbered from 0, meet each other and, by negative numbers, every block of the main part
    mine = rows.join(sized(some), "root").join(sized(outside.select("root", "body", F.lit(True).alias("out"))), ["root", "body"], "left")
    own = F.pmod(F.xxhash64("body", F.lit(3)), F.col("cuts")).cast("int")
    out = mine.where("out").withColumn("own", own)
    among = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("root", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "body", "text")
    against = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", (-1 - F.col("k")).alias("i"), F.col("own").alias("j"), "body", "text")
    rest = mine.where("out IS NULL").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("root", (-1 - F.col("block")).alias("i"), F.col("k").alias("j"), "body", "text")
    second = among.union(against).union(rest).groupBy("root", "i", "j").applyInPandas(compare, LINK)
    return links.union(cut_lineage(second.distinct()))


def groups(docs: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """file, row (a row's name), doc_id and group (equal for rows that chains of near copies connect) of every row of numbered docs.

    Only texts of candidates are gathered, one for each body.
    """
    marked = cut_lineage(marks(docs, names, id_col, text_col))
    distinct = cut_lineage(marked.groupBy("body", *COLUMNS).agg(F.min(F.struct("file", "row")).alias("at"), F.count("*").alias("n")))
    proposed = components(candidates(distinct.select("body", *COLUMNS)))
    proposed = cut_lineage(proposed.union(proposed.select(F.col("root").alias("node"), "root")).distinct())
    wanted = distinct.select("body", "at.*").join(proposed.withColumnRenamed("node", "body"), "body")
    texts = docs.select(*(own(docs, c).alias(a) for c, a in zip(names, ("file", "row"), strict=True)), own(docs, text_col).alias("text"))
    members = cut_lineage(texts.join(sized(wanted), ["file", "row"]).select("root", "body", "text"))
    tree = components(verified(members)).toDF("body", "root")
    class_of = cut_lineage(distinct.select("body", "n").join(tree, "body", "left").select("body", F.coalesce("root", "body").alias("group"), "n"))
    return join_sized(marked.select("file", "row", "doc_id", "body"), class_of, "body", marked.count()).select("file", "row", "doc_id", "group")
