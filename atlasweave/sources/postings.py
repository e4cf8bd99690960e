"""An inverted index of names and words, written once and read by its postings.

names: every key under which a name is found, a node's id, what follows its last slash, each name whole and from each of its words on (the first
KEY letters); words: every word of names and texts with the nodes that hold it; texts: what a hit is shown with.  The first two are kept in
folders by the first letters of a key and sorted by key within files, so a look-up opens the folder of its letters only and skips the
row groups that its key can't be in; a frequent word's postings are spread over several files.  Texts are in folders by a hash of the id.

Names are inherited: a node also has the names and texts of the nodes that stand for its meaning.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import normalised, word_prefix
from . import versions
from .lift import Graph

#: Letters of a key that are stored; first letters that name a folder (more of them for larger tables); folders for keys that begin
#: with other than small Latin letters and digits; folders of texts.
KEY, LETTERS, OTHERS, BUCKETS = 64, 1, 16, 32
#: Hits that the scan of texts is filtered by.
FEW = 1 << 6
ENTRY = ["id", "type", "scope", "name", "text"]


def folder_of(key: Column, letters: int) -> Column:
    """The folder of a key: its first letters, or a number for keys that begin otherwise."""
    first = F.substring(key, 1, letters)
    return F.when(first.rlike(f"^[a-z0-9]{{1,{letters}}}$"), first).otherwise(F.concat(F.lit("~"), F.pmod(F.xxhash64(F.substring(key, 1, 1)), F.lit(OTHERS)).cast("string")))


def _bucket(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int")


def entries(graph: Graph, name_preds: list[str] | None = None, text_preds: list[str] | None = None, meaning: str | None = "hasMeaning", scope_pattern: str = r"^report/([^/]+)") -> DataFrame:
    """id, type, scope, name and text of a graph's nodes: labels and values of the name properties, values of the text properties.

    A node inherits along the relation `meaning` the names of its target, both as names and as texts, and its texts.
    """
    nodes = graph.nodes.select("id", "type")
    nothing = F.lit(None).cast("string")
    names = graph.nodes.select("id", F.col("label").alias("name"))
    if name_preds:
        names = names.unionByName(graph.literals_of(name_preds).select(F.col("subj").alias("id"), F.col("value").alias("name")))
    rows = names.select("id", "name", nothing.alias("text"))
    if text_preds:
        rows = rows.unionByName(graph.literals_of(text_preds).select(F.col("subj").alias("id"), nothing.alias("name"), F.col("value").alias("text")))
    if meaning:
        own = graph.edges_of([meaning]).select("src", F.col("dst").alias("id")).join(rows, "id")
        spread = F.explode(F.array(F.struct("name", "text"), F.struct(nothing.alias("name"), F.col("name").alias("text"))))
        rows = rows.unionByName(own.select(F.col("src").alias("id"), spread.alias("x")).select("id", "x.name", "x.text"))
    rows = rows.where("name IS NOT NULL OR text IS NOT NULL").join(nodes, "id").distinct()
    scope = F.regexp_extract("id", scope_pattern, 1)
    return rows.select("id", "type", F.when(scope != "", scope).alias("scope"), "name", "text")


def tables(found: DataFrame, letters: int = LETTERS, slices: int = 1, staged: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> dict[str, versions.Table]:
    """The tables to publish for entries(id, type, scope, name, text); the rows of some folders at a time with several slices.

    staged may keep the words of all texts, which the ranges and every slice read, so that texts are split once.
    """
    head = lambda c: F.substring(c, 1, KEY)
    named = found.where("name IS NOT NULL").select("id", "type", "scope", "name", normalised(F.col("name")).alias("plain"))
    from_words = F.transform(F.regexp_extract_all("plain", F.lit(rf"\b(?=(.{{1,{KEY}}}))"), F.lit(1)), lambda k: F.struct(F.lit("name").alias("how"), k.alias("key")))
    ids = F.array(F.struct(F.lit("id").alias("how"), head(F.lower("id")).alias("key")), F.struct(F.lit("id").alias("how"), head(F.lower(F.substring_index("id", "/", -1))).alias("key")))
    whole = F.array(F.struct(F.lit("name").alias("how"), head(F.col("plain")).alias("key")))
    keys = named.select("id", "type", "scope", "name", F.explode(F.array_distinct(F.concat(ids, whole, from_words))).alias("k")).select("id", "type", "scope", "name", "k.how", "k.key")
    keys = keys.where("key <> ''").withColumn("folder", folder_of(F.col("key"), letters))

    def words(column: str, in_name: bool) -> DataFrame:
        every = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{Nd}\p{Mn}_]+"), F.lit(0)), head))
        return found.where(F.col(column).isNotNull()).select("id", "type", "scope", F.explode(every).alias("word"), F.lit(in_name).alias("in_name"))

    held = staged(words("name", True).unionByName(words("text", False))).withColumn("folder", folder_of(F.col("word"), letters))
    once = lambda rows: rows.groupBy("folder", "word", "id", "type", "scope").agg(F.max("in_name").alias("in_name"))
    by_folder, bucket = versions.dealt(F.xxhash64("folder"), slices), _bucket(F.col("id"))
    return {
        "names": versions.Table(keys, ("folder",), ("key", "id", "name"), DataFrame.distinct, by_folder),
        "words": versions.Table(held, ("folder",), ("word", "id"), once, by_folder),
        "texts": versions.Table(found.select(*ENTRY).withColumn("bucket", bucket), ("bucket",), ("id", "name", "text"), None, versions.dealt(bucket, slices)),
    }


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    version: versions.Version

    @property
    def letters(self) -> int:
        return int(self.version.meta["letters"])

    def read(self, name: str, types: list[str] | None = None, scope: str | None = None) -> DataFrame:
        rows = self.version.read(self.spark, name)
        if types:
            rows = rows.where(F.col("type").isin(types))
        return rows.where(F.col("scope") == scope) if scope else rows

    def keys(self, want: str, id_: str, types: list[str] | None = None, scope: str | None = None) -> DataFrame:
        """Postings of names whose key begins with `want`, or whose id key is `id_`: rows of few folders."""
        near = F.col("folder") == folder_of(F.lit(want), self.letters)
        if len(want) < self.letters:  # longer keys are in folders of longer names, or among the others
            near = near | F.startswith(F.col("folder"), F.lit(want)) | (F.col("folder") == folder_of(F.lit(want + " "), self.letters))
        mine = F.col("folder") == folder_of(F.lit(id_), self.letters)
        rows = self.read("names", types, scope).where(near | mine)
        return rows.where((F.col("how") == "name") & F.startswith("key", F.lit(want[:KEY])) | (F.col("how") == "id") & (F.col("key") == id_[:KEY]))

    def postings(self, words: list[str], types: list[str] | None = None, scope: str | None = None) -> DataFrame:
        """Postings of all words that begin with one of the given ones."""
        near = [folder_of(F.lit(w), self.letters) for w in words] + [folder_of(F.lit(w + " "), self.letters) for w in words if len(w) < self.letters]
        own = F.col("folder").isin(near)
        for w in words:
            own = own | F.startswith(F.col("folder"), F.lit(w)) if len(w) < self.letters else own
        rows = self.read("words", types, scope).where(own)
        begins = [F.startswith("word", F.lit(w[:KEY])) for w in words]
        hit = begins[0]
        for b in begins[1:]:
            hit = hit | b
        return rows.where(hit)


def publish(spark: SparkSession, folder: str, found: DataFrame, base: versions.Version | None = None, letters: int = LETTERS, slices: int = 1) -> Index:
    """Write an index of entries(id, type, scope, name, text), which are read several times, in each slice again, and so should cost little or be stored."""
    place = f"{folder}/staged-{uuid4().hex}"

    def staged(rows: DataFrame) -> DataFrame:
        rows.write.parquet(place)
        return spark.read.schema(rows.schema).parquet(place)

    try:
        return Index(spark, versions.publish(spark, folder, tables(found, letters, slices, staged), base, {"letters": str(letters)}))
    finally:
        versions.remove(spark, place)


def open_index(spark: SparkSession, folder: str) -> Index:
    version = versions.current(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no index has been published in {folder}")
    return Index(spark, version)


def resolve(index: Index, asked: str, type_rank: dict[str, int] | None = None, limit: int = 10, types: list[str] | None = None, scope: str | None = None) -> DataFrame:
    """As lookup.resolve, from the postings: id, type, name, score and more; types and scope narrow what is looked at."""
    text, want = asked.strip().lower(), " ".join(w for w in re.split(r"[\s_\-]+", asked.lower()) if w)
    if not text or not want:
        raise ValueError("nothing is asked for")
    plain = normalised(F.col("name"))
    score = (
        F.when((F.lower("id") == text) | (F.lower(F.substring_index("id", "/", -1)) == text), 3)
        .when(plain == want, 2)
        .when(F.lit(len(text) >= 3) & plain.rlike(word_prefix(want)), 1)
        .otherwise(0)
    )
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in type_rank.items() for x in kv])[F.col("type")], F.lit(99)) if type_rank else F.lit(0)
    rows = index.keys(want, text, types, scope).withColumn("score", score).where("score > 0")
    hits = rows.groupBy("id", "type").agg(F.max("score").alias("score"), F.min("name").alias("name")).withColumn("rank", rank)
    more = hits.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("more"))
    return hits.orderBy(F.desc("score"), "rank", "id").limit(limit).join(F.broadcast(more)).select("id", "type", "name", "score", "more")  # one row


def search(index: Index, query: str, limit: int = 20, width: int = 160, types: list[str] | None = None, scope: str | None = None) -> DataFrame:
    """id, type, score and snippet of the best nodes that hold all words of the query, in any of their names and texts.

    A word counts 3 if a name has it, else 1; the whole phrase in a text adds 5.  The snippet is of the first text with the phrase, else with
    the first word.  Ties go by id.
    """
    words = list(dict.fromkeys(w for w in re.findall(r"\w+", query.lower()) if len(w) > 1))
    if not words:
        raise ValueError("the query has no word of two letters or more")
    counts = [w for w in re.findall(r"\w+", query.lower()) if len(w) > 1]
    best = [F.max(F.when(F.startswith("word", F.lit(w[:KEY])), F.when(F.col("in_name"), 3).otherwise(1))).alias(f"w{k}") for k, w in enumerate(words)]
    found = index.postings(words, types, scope).groupBy("id", "type").agg(*best)
    total = sum((F.col(f"w{words.index(w)}") for w in counts if len(w) <= KEY), F.lit(0))
    hits = cut(found.where(" AND ".join(f"w{k} IS NOT NULL" for k in range(len(words)))).select("id", "type", total.alias("words")))
    buckets = [r.bucket for r in hits.select(_bucket(F.col("id")).alias("bucket")).distinct().collect()]  # BUCKETS rows at most
    texts = index.read("texts").where(F.col("bucket").isin(buckets))
    few = [r.id for r in hits.select("id").limit(FEW + 1).collect()]
    texts = texts.where(F.col("id").isin(few)) if len(few) <= FEW else texts
    phrase, low = " ".join(query.lower().split()), F.lower(F.coalesce("text", F.lit("")))
    at = F.when(F.instr(low, phrase) > 0, F.instr(low, phrase)).otherwise(F.greatest(F.instr(low, words[0]), F.lit(1)))
    shown = F.substring(F.coalesce("text", F.lit("")), F.greatest(at - 40, F.lit(1)), F.lit(width))
    order = F.struct((~F.contains(low, F.lit(phrase))).alias("a"), (F.instr(low, words[0]) == 0).alias("b"), F.col("text").isNull().alias("c"), F.col("text").alias("d"))
    # a word of more than KEY letters was looked up by its first ones, and is looked for here
    whole = lambda w: F.max(F.when(F.lower("name").rlike(word_prefix(w)), 3).when(low.rlike(word_prefix(w)), 1))
    long = {f"l{k}": whole(w) for k, w in enumerate(words) if len(w) > KEY}
    rows = hits.join(texts.drop("type"), "id").groupBy("id", "type", "words").agg(F.max(F.when(F.contains(low, F.lit(phrase)), 5).otherwise(0)).alias("phrase"), F.min_by(shown, order).alias("snippet"), *[c.alias(n) for n, c in long.items()])
    score = F.col("words") + F.col("phrase")
    for w in counts:
        if len(w) > KEY:
            score = score + F.col(f"l{words.index(w)}")
    return rows.where(" AND ".join([f"{n} IS NOT NULL" for n in long] or ["true"])).select("id", "type", score.alias("score"), "snippet").orderBy(F.desc("score"), "id").limit(limit)


def terms_hit(index: Index, query: str, limit: int = 5, term_types: tuple[str, ...] = ("Class", "Property", "Term")) -> DataFrame:
    """The vocabulary terms among the hits of a search: id, score and snippet of the first ones."""
    return search(index, query, limit, types=list(term_types)).select("id", "score", "snippet")
