"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table with the lengths (in tokens) of the corpus's frequent pre-tokens.  Tier two is
a cache in each Python worker: what the table lacks is encoded once by the tokenizer library and remembered.
No pre-token is ever shuffled; the table comes from bounded heavy-hitter summaries, one per partition, which
cover every document and are merged by a small aggregation.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows stay
repeated; columns other than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SIMPLE, byte_letters, char_class

#: Distinct chunks that a partition's summary holds before the rare half is dropped, and entries it emits.
SUMMARY_SIZE, SUMMARY_EMITS = 1 << 17, 4096
#: Entries of the broadcast table.
TABLE_SIZE = 1 << 15
#: Bytes of a worker's cache (beyond that it starts anew), and characters of a chunk that is kept in it at most.
CACHE_BYTES, CACHED = 1 << 26, 256
WHITE = re.compile(r"[ \t\n\r]+")

_cache: dict[str, tuple] = {}
_tokenizers: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a file, once for each process."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def pre_token_pattern() -> re.Pattern:
    """Pre-tokens of the lower-casing word vocabulary, for simple characters."""
    letter, number = char_class("L"), char_class("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\t\n\r {letter}{number}]+")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent pre-tokens of a partition, with lower bounds of their counts."""
    odd, counts = re.compile(NOT_SIMPLE), Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(c for c in text.lower().split() if len(c) <= CACHED and not odd.search(c)) if odd.search(text) else counts.update(text.lower().split())
                if len(counts) > 2 * SUMMARY_SIZE:
                    counts = Counter(dict(counts.most_common(SUMMARY_SIZE)))
    tokens, split = Counter(), pre_token_pattern().findall
    for chunk, n in counts.items():
        for token in split(chunk):
            tokens[token] += n
    top = tokens.most_common(SUMMARY_EMITS)
    yield pa.RecordBatch.from_pydict({"token": [t for t, _ in top], "n": pa.array([n for _, n in top], pa.int64())})


def frequent_lengths(docs: DataFrame, tokenizer_path: str, text_col: str = "text", size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of the corpus's most frequent pre-tokens: at most `size` entries reach the driver."""
    model, letters = load(tokenizer_path).model, byte_letters()
    top = (
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(_summaries, "token string, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(size)
        .collect()
    )
    return {row.token: len(model.tokenize(row.token.encode().decode("latin-1").translate(letters))) for row in top}


class _Lengths(dict):
    """Tokens of a white-space-free chunk of simple characters in small letters, kept in a bounded cache.

    A miss is split into pre-tokens, which are looked up in the table, else encoded.
    """

    def __init__(self, table: dict[str, int], tokenizer) -> None:
        super().__init__()
        self.table, self.tokenizer, self.tokenize, self.letters, self.split, self.room = table, tokenizer, tokenizer.model.tokenize, byte_letters(), pre_token_pattern().findall, CACHE_BYTES

    def spell(self, token: str) -> str:
        return token.encode().decode("latin-1").translate(self.letters)

    def count(self, chunk: str) -> int:
        known = [(token, self.table.get(token)) for token in self.split(chunk)]
        return sum(len(self.tokenize(self.spell(token))) if n is None else n for token, n in known)

    def __missing__(self, chunk: str) -> int:
        n = self.count(chunk)
        if len(chunk) <= CACHED:
            self.room -= 2 * len(chunk) + 100
            if self.room < 0:
                self.clear()
                self.room = CACHE_BYTES
            self[chunk] = n
        return n


class _AnyLengths(_Lengths):
    """Tokens of any white-space-free chunk as it stands.

    One with other than simple characters is normalised and split by the library's own parts, and its pre-tokens are looked up too; one
    with a special token's string goes to the library.
    """

    def __init__(self, simple: _Lengths, special: list[str]) -> None:
        super().__init__(simple.table, simple.tokenizer)
        self.simple, self.spelled = simple, {self.spell(t): n for t, n in simple.table.items()}
        self.odd, self.special = re.compile(NOT_SIMPLE).search, re.compile("|".join(map(re.escape, special)) or "(?!)").search

    def count(self, chunk: str) -> int:
        if self.special(chunk):
            return len(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if not self.odd(chunk):
            return self.simple[chunk.lower()]
        parts = [part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(chunk))]
        known = [self.spelled.get(part) for part in parts]
        return sum(len(self.tokenize(part)) if n is None else n for part, n in zip(parts, known, strict=True))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document; see the module for edge cases.

    Texts are split at white space, where no token goes on.  Simple texts are put in small letters first, so that their chunks are
    known in fewer forms; of other texts the library's normaliser does it chunk by chunk.
    """
    special = sorted(t.content for t in load(tokenizer_path).get_added_tokens_decoder().values())
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path, text_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        if _cache.get(tokenizer_path, (None, None))[0] != shared.value:
            lengths = _Lengths(shared.value, tokenizer)
            _cache[tokenizer_path] = shared.value, lengths, _AnyLengths(lengths, special)
        _, lengths, every = _cache[tokenizer_path]
        odd = re.compile("|".join([NOT_SIMPLE, *map(re.escape, special)])).search
        for batch in batches:
            n = []
            for text in batch.column(2).to_pylist():
                if not text:
                    n.append(0)
                elif odd(text):
                    n.append(sum(map(every.__getitem__, filter(None, WHITE.split(text)))))
                else:
                    n.append(sum(map(lengths.__getitem__, text.lower().split())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
            F.col(text_col).alias("text"),
        )
        .mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
