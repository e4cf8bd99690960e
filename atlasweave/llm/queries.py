"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudo_likelihood import train_and_score

    return train_and_score(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, remainder, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    found = identify(docs.select("doc_id", "text"), train(docs, held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    found = shards(table(spark, sf_dir, "documents"), n_shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect, train

    return detect(table(spark, sf_dir, "documents"), train())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), radius=4, shingle=4)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan, train

    return scan(table(spark, sf_dir, "documents"), train())


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dual_tree import cluster, members

    return members(cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dims=64, scale=1024))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .id_files import read_documents, write_ids

    folder = f"{shared_folder(spark)}/ids-{uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, folder)


def _lloyd_sql(k: int, rounds: int, seed: int, dims: int) -> str:
    """Lloyd's rounds of op11 one after the other, on rows (vector, place, component)."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM kept)",
        f"first AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) <= {k})",
        "c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS p FROM first)",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM x JOIN c{i} USING (p) GROUP BY ALL)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        steps.append(f"m{i} AS (SELECT c, p, CAST(floor(sum(x) / count(*)) AS BIGINT) AS y FROM x JOIN a{i} USING (r) GROUP BY ALL)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, p, coalesce(m.y, o.y) AS y FROM c{i} o LEFT JOIN m{i} m USING (c, p))")
    return f"""WITH {", ".join(steps)}, named AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY ALL)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN named USING (c)"""


def _windows_sql(side: str, rows: str) -> str:
    """Common table expressions for the windows of one side of op2; rows is a query for key and text."""
    from .decontamination import UNITS, WINDOW

    lead = lambda column: ", ".join([column, *(f"lead({column}, {k}) OVER o" for k in range(1, WINDOW))])
    point, comma = "chr(57345)", "chr(57346)"  # stand for points and commas between digits
    inner = "replace(coalesce(text, ''), '@', ' ')"
    for sign, mark in ((".", point), (",", comma)) * 2:
        inner = rf"regexp_replace({inner}, '([0-9])[{sign}]([0-9])', '\1' || {mark} || '\2', 'g')"
    token = f"[\\p{{L}}0-9' || {point} || {comma} || ']+"
    return rf"""
        {side}_text AS (SELECT key, {inner} AS text FROM ({rows})),
        {side}_raw AS (
            SELECT key, 0 AS form, regexp_extract_all(text, '{token}[^\p{{L}}0-9' || {point} || {comma} || ']*') AS raw FROM {side}_text
            UNION ALL SELECT key, 1, regexp_extract_all(lower(text), '{token}') FROM {side}_text
        ), {side}_split AS (
            SELECT key, form, i, regexp_extract(raw, '^{token}') AS raw, regexp_full_match(raw, '{token}[ \t\n\r]+') AS spaced, form = 0 AND regexp_full_match(regexp_extract(raw, '^{token}'), '\p{{Lu}}\p{{Ll}}+') AS is_name
            FROM (SELECT key, form, unnest(raw) AS raw, generate_subscripts(raw, 1) AS i FROM {side}_raw)
        ), {side}_token AS (
            SELECT key, form, raw, is_name, row_number() OVER (PARTITION BY key, form ORDER BY i) AS i
            FROM (SELECT *, is_name AND lag(is_name AND spaced, 1, false) OVER (PARTITION BY key, form ORDER BY i) AS goes_on FROM {side}_split) WHERE NOT goes_on
        ), {side}_near AS (
            SELECT *, raw >= '0' AND raw < ':' AS is_number, lag(raw >= '0' AND raw < ':', 1, false) OVER (PARTITION BY key, form ORDER BY i) AS after_number FROM {side}_token
        ), {side}_code AS (
            SELECT key, form, i, lower(raw) AS value, CASE WHEN is_number THEN '#' WHEN is_name THEN '@'
                WHEN after_number AND lower(raw) IN ({", ".join(f"'{u}'" for u in UNITS)}) THEN '%' ELSE lower(raw) END AS code FROM {side}_near
        ), {side}_lead AS (
            SELECT key, form, i, [{lead("code")}] AS codes, [{lead("value")}] AS vals FROM {side}_code WINDOW o AS (PARTITION BY key, form ORDER BY i)
        ), {side}_hits AS (
            SELECT key, form, i, CASE WHEN literal >= 2 THEN 'T' || form || array_to_string(codes, ' ') ELSE 'V' || form || array_to_string(vals, '|') || array_to_string(codes, ' ') END AS w,
                CASE WHEN literal >= 2 THEN list_transform(list_zip(codes, vals), lambda x: CASE WHEN x[1] IN ('#', '@', '%') THEN x[1] || x[2] END) END AS slots
            FROM (SELECT *, len(list_filter(codes, lambda c: c NOT IN ('#', '@', '%'))) AS literal FROM {side}_lead WHERE codes[{WINDOW}] IS NOT NULL)
        ), {side}_short AS (
            {" UNION ALL ".join(f"SELECT key, 2 AS form, i, array_to_string(vals[1:{n}], '|') AS w, NULL AS slots FROM {side}_lead WHERE form = 1 AND vals[{n}] IS NOT NULL" for n in range(1, WINDOW))}
        )"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_decontamination, op3_top_k, op4_language_id, op5_token_counts, op6_packing, op7_sharding, op8_pii, op9_simhash, op10_secrets, op11_centroid_clustering, op12_ranked_search, op13_id_files)}


def oracle_sql() -> dict[str, str]:
    from .decontamination import CONSISTENT, COVERED, WINDOW

    return {
        "op2_decontamination": f"""
            WITH docs AS (SELECT row_number() OVER () AS key, doc_id, text FROM documents),
            items AS (SELECT row_number() OVER () AS key, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
            {_windows_sql("d", "SELECT key, text FROM docs")}, {_windows_sql("b", "SELECT key, text FROM items")},
            wanted AS (
                SELECT * FROM b_hits
                UNION ALL SELECT key, 2, 1, array_to_string(raw, '|'), NULL FROM b_raw WHERE form = 1 AND len(raw) BETWEEN 1 AND {WINDOW - 1}
            ), sizes AS (
                SELECT key AS item, form, count(DISTINCT w) AS n FROM wanted GROUP BY ALL
            ), joined AS (
                SELECT d.key AS doc, b.key AS item, form, w, d.slots AS v, b.slots AS u, d.i - b.i AS shift, b.i AS start, coalesce(len(list_filter(b.slots, lambda x: x IS NOT NULL)), 0) > 0 AS slotted
                FROM (SELECT * FROM d_hits UNION ALL SELECT * FROM d_short) d JOIN wanted b USING (form, w)
            ), slots AS (
                SELECT DISTINCT doc, item, form, shift, start + p AS place, u[p] AS a, v[p] AS b FROM joined, range(1, {WINDOW + 1}) AS r(p) WHERE slotted AND u[p] IS NOT NULL
            ), pairs AS (
                SELECT doc, item, form, shift, a, b, count(*) AS c FROM slots GROUP BY ALL
            ), mapped AS (
                SELECT *, row_number() OVER (PARTITION BY doc, item, form, shift, a ORDER BY c DESC, b) = 1 AND row_number() OVER (PARTITION BY doc, item, form, shift, b ORDER BY c DESC, a) = 1 AS ok FROM pairs
            ), consistent AS (
                SELECT doc, item, form, shift FROM mapped GROUP BY ALL HAVING 100 * coalesce(sum(c) FILTER (ok), 0) >= {CONSISTENT} * sum(c)
            ), covered AS (
                SELECT doc, item, form, count(DISTINCT w) AS covered FROM joined LEFT JOIN (SELECT *, true AS ok FROM consistent) USING (doc, item, form, shift) WHERE NOT slotted OR ok GROUP BY ALL
            ), found AS (
                SELECT DISTINCT doc, item, item_id FROM covered JOIN sizes USING (item, form) JOIN items i ON i.key = item WHERE 100 * covered >= {COVERED} * n
            ), listed AS (
                SELECT doc, count(*) AS n_items, string_agg(coalesce(CAST(item_id AS VARCHAR), 'null'), ',' ORDER BY item_id) AS item_ids FROM found GROUP BY ALL
            )
            SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids
            FROM docs LEFT JOIN listed ON doc = key""",
        "op3_top_k": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
                FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), scored AS (
                SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
            ), ranked AS (
                SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
            )
            SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
        "op11_centroid_clustering": _lloyd_sql(k=8, rounds=10, seed=3, dims=64),
        "op12_ranked_search": r"""
            WITH words AS (
                SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL
            ), docs AS (SELECT d, doc_id, t, len(t) AS n FROM words WHERE len(t) > 0
            ), size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs
            ), tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM docs) GROUP BY ALL
            ), weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term, docs
            ), items AS (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
            ), asked AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items
            ), scored AS (
                SELECT i, item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
                FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN docs USING (d), size GROUP BY ALL
            ), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
            SELECT * FROM ranked WHERE rank <= 50""",
    }
