"""Finding things by name, by near name, and by words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised, word_prefix


def resolve(names: DataFrame, asked: str, type_rank: dict[str, int] | None = None, limit: int = 10) -> DataFrame:
    """The best matches in names(id, type, name) for a name: id, type, name, score and more (how many others match).

    Score 3: the id, or what follows its last slash; 2: a name; 1: a word of a name begins with it (3 letters or more).
    Ties go by type rank, then id.
    """
    want = F.lower(F.trim(F.regexp_replace(F.lit(asked), r"[\s_\-]+", " ")))
    text = asked.strip().lower()
    name = normalised(F.col("name"))
    score = (
        F.when((F.lower("id") == text) | (F.lower(F.substring_index("id", "/", -1)) == text), 3)
        .when(name == want, 2)
        .when(F.lit(len(text) >= 3) & name.rlike(word_prefix(" ".join(text.replace("_", " ").replace("-", " ").split()))), 1)
        .otherwise(0)
    )
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in type_rank.items() for x in kv])[F.col("type")], F.lit(99)) if type_rank else F.lit(0)
    hits = names.withColumn("score", score).where("score > 0").groupBy("id", "type").agg(F.max("score").alias("score"), F.min("name").alias("name")).withColumn("rank", rank)
    more = hits.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("more"))
    return hits.orderBy(F.desc("score"), "rank", "id").limit(limit).join(F.broadcast(more)).select("id", "type", "name", "score", "more")  # one row


def did_you_mean(names: DataFrame, asked: str, n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """The n names(name) closest to a misspelt one by matching blocks (2 * matched / total letters), cutoff or more, both as they are compared.

    Names whose length alone rules out the cutoff never reach Python; ties go to the greater name.
    """
    want = " ".join(re.split(r"[\s_\-]+", asked.lower())).strip()
    size, name = len(want), normalised(F.col("name"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        matcher = SequenceMatcher()
        matcher.set_seq2(want)
        for frame in frames:
            out = []
            for name in frame["name"]:
                matcher.set_seq1(name)
                if matcher.real_quick_ratio() >= cutoff and matcher.quick_ratio() >= cutoff and (r := matcher.ratio()) >= cutoff:
                    out.append((name, r))
            yield pd.DataFrame(out, columns=["name", "ratio"])

    length = F.char_length("name")
    possible = names.select(name.alias("name")).where(F.col("name").isNotNull() & (2 * F.least(length, F.lit(size)) >= cutoff * (length + size))).distinct()
    return possible.mapInPandas(run, "name string, ratio double").orderBy(F.desc("ratio"), F.desc("name")).limit(n)


def _count(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def search(texts: DataFrame, query: str, limit: int = 20, width: int = 160) -> DataFrame:
    """id, score and snippet of the best rows of texts(id, name, text) that hold all words of the query.

    A word (a run of letters, digits and underscores, two at least) matches where a word begins with it; it counts 3 in the name,
    else 1; the whole phrase in the text adds 5.  Ties go by id; a query without a word is an error.
    """
    words = [w for w in re.findall(r"\w+", query.lower()) if len(w) > 1]
    if not words:
        raise ValueError("the query has no word of two letters or more")
    name, text = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    rows, score = texts, F.lit(0)
    for w in words:
        in_name, in_text = name.rlike(word_prefix(w)), text.rlike(word_prefix(w))
        rows = rows.where(in_name | in_text)
        score = score + F.when(in_name, 3).otherwise(1)
    phrase = " ".join(query.lower().split())
    score = score + 5 * _count(F.contains(text, F.lit(phrase)))
    at = F.when(F.instr(text, phrase) > 0, F.instr(text, phrase)).otherwise(F.greatest(F.instr(text, words[0] if words else phrase), F.lit(1)))
    hits = rows.select("id", score.alias("score"), F.substring(F.coalesce("text", F.lit("")), F.greatest(at - 40, F.lit(1)), F.lit(width)).alias("snippet"))
    return hits.orderBy(F.desc("score"), "id").limit(limit)
