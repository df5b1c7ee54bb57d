"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import crc32_of
from sparquill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_tiktoken_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sparquill.llm.tiktoken_codec import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages")))


def op5_pseudo_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.pseudo_lm import pseudo_likelihood

    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.langid import predict, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc32_of("doc_id") % 4 != 2))
    held = F.coalesce(crc32_of("doc_id") % 4 == 2, F.lit(False)).alias("held_out")
    return predict(docs, model).select("doc_id", held, "lang_pred", "score")


def op7_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.common import fresh_dir
    from sparquill.llm.token_cache import count_tokens, fill_cache

    docs, tokenizer, cache = table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), fresh_dir(spark, "token-cache")
    fill_cache(docs, tokenizer, cache)  # the first run's misses; the second finds every count stored
    return count_tokens(docs, tokenizer, cache, limit=1024)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.media_store import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op10_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.toxicity import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc32_of("doc_id") % 5 != 0))
    held = F.coalesce(crc32_of("doc_id") % 5 == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted")


def op11_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.sharding import assign_shards

    placed = assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.merkle import manifest, one_more_char

    found = manifest(table(spark, sf_dir, "documents"), tampered=one_more_char())
    proof = F.sha2("proof", 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: crc32 of a text's UTF-8 bytes, bit by bit.
CRC32 = """CAST(xor(list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS UBIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, CAST(3988292384 AS UBIGINT) * (a & 1)))
), CAST(4294967295 AS UBIGINT)) AS BIGINT)"""
#: A manifest's form of a value.
VALUE = "coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || CAST({v} AS VARCHAR), '-')"


def _lloyd_sql(rounds: int = 6, entries: int = 16, parts: int = 8, scale: int = 4096) -> str:
    """Plain Lloyd rounds, one pair of tables each, without bounds."""
    sql = f"""
        WITH e AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), x AS MATERIALIZED (
            SELECT r, CAST(p AS INTEGER) AS p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM e, range({parts}) t(p)
        ), c0 AS MATERIALIZED (
            SELECT p, s.n AS k, x AS y FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS n FROM e WHERE vec_id IS NOT NULL) s ON x.r = s.r WHERE s.n < {entries}
        )"""
    for t in range(rounds + 1):
        sql += f""", a{t} AS MATERIALIZED (
            SELECT r, x.p, min([list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - y[j]) * (x[j] - y[j]))), k]) AS best
            FROM x JOIN c{t} c ON x.p = c.p GROUP BY r, x.p
        )"""
        if t < rounds:
            sql += f""", m{t} AS (
            SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS y
            FROM (
                SELECT p, k, j, sum(v) AS s, count(*) AS n
                FROM (SELECT x.p, a.best[2] AS k, unnest(x.x) AS v, unnest(range(len(x.x))) AS j FROM x JOIN a{t} a ON x.r = a.r AND x.p = a.p)
                GROUP BY p, k, j
            ) GROUP BY p, k
        ), c{t + 1} AS MATERIALIZED (
            SELECT c.p, c.k, coalesce(m.y, c.y) AS y FROM c{t} c LEFT JOIN m{t} m ON c.p = m.p AND c.k = m.k
        )"""
    return f"""{sql}, f AS (
            SELECT r, string_agg(printf('%02x', CAST(best[2] AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY r
        )
        SELECT e.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256
        FROM e JOIN f ON e.r = f.r
    """


ORACLE_SQL = {
    "op1_maxscore_topk": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM e q JOIN e c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op4_warc_dictionary": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest FROM p
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
        )
        SELECT page_id,
               CAST(payload_bytes AS BIGINT) AS payload_bytes,
               payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op11_prefix_shards": f"""
        WITH d AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {CRC32.format(text="coalesce(text, '')")} AS text_crc32
            FROM documents
        ), s AS (
            SELECT *, row_number() OVER o AS place, sum(size) OVER o - size AS ahead, sum(size) OVER () AS total
            FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)
        ), c AS (
            SELECT *, least((2 * ahead + size) * 40 // (2 * total), 39) AS shard FROM s
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
               CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM c
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce('=' || lang, '') AS g, lang,
                   {VALUE.format(v="doc_id")} || {VALUE.format(v="source")} || {VALUE.format(v="lang")} AS head,
                   n_chars, {VALUE.format(v="text")} AS tail,
                   doc_id IS NOT NULL AND n_chars IS NOT NULL AND {CRC32.format(text="coalesce(CAST(doc_id AS VARCHAR), '')")} % 7 = 0 AS altered
            FROM documents
        ), l AS (
            SELECT doc_id, g, lang, sha256(head || {VALUE.format(v="n_chars")} || tail) AS leaf,
                   CASE WHEN altered THEN sha256(head || {VALUE.format(v="(CAST(n_chars AS HUGEINT) + 1)")} || tail) END AS other
            FROM d
        ), n AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS c FROM l
        ), lower_levels(level, g, i, c, h) AS (
            SELECT 0, g, i, c, leaf FROM n
            UNION ALL
            SELECT a.level + 1, a.g, a.i // 2, (a.c + 1) // 2, sha256(a.h || coalesce(b.h, ''))
            FROM lower_levels a LEFT JOIN lower_levels b ON a.g = b.g AND b.i = a.i + 1
            WHERE a.c > 1 AND a.i % 2 = 0
        ), top AS (
            SELECT x.g, x.level AS depth, x.h AS subroot, row_number() OVER (ORDER BY y.lang NULLS FIRST) - 1 AS gi, count(*) OVER () AS gc
            FROM lower_levels x JOIN (SELECT DISTINCT g, lang FROM n) y ON x.g = y.g WHERE x.c = 1
        ), upper_levels(level, i, c, h) AS (
            SELECT 0, gi, gc, subroot FROM top
            UNION ALL
            SELECT a.level + 1, a.i // 2, (a.c + 1) // 2, sha256(a.h || coalesce(b.h, ''))
            FROM upper_levels a LEFT JOIN upper_levels b ON b.i = a.i + 1
            WHERE a.c > 1 AND a.i % 2 = 0
        ), crown AS (
            SELECT h AS root, level AS height FROM upper_levels WHERE c = 1
        ), steps AS (
            SELECT n.g, n.i, z.level AS step, (n.i >> z.level) % 2 AS side, s.h AS sibling
            FROM n JOIN top t ON n.g = t.g JOIN (SELECT DISTINCT level FROM lower_levels) z ON z.level < t.depth
            LEFT JOIN lower_levels s ON s.g = n.g AND s.level = z.level AND s.i = xor(n.i >> z.level, 1)
            UNION ALL
            SELECT n.g, n.i, t.depth + z.level, (t.gi >> z.level) % 2, s.h
            FROM n JOIN top t ON n.g = t.g CROSS JOIN crown JOIN (SELECT DISTINCT level FROM upper_levels) z ON z.level < crown.height
            LEFT JOIN upper_levels s ON s.level = z.level AND s.i = xor(t.gi >> z.level, 1)
        ), climbed(g, i, step, h) AS (
            SELECT g, i, 0, coalesce(other, leaf) FROM n
            UNION ALL
            SELECT k.g, k.i, k.step + 1, sha256(CASE WHEN s.side = 1 THEN coalesce(s.sibling, '') || k.h ELSE k.h || coalesce(s.sibling, '') END)
            FROM climbed k JOIN steps s ON s.g = k.g AND s.i = k.i AND s.step = k.step
        ), last AS (
            SELECT g, i, arg_max(h, step) AS folded_root FROM climbed GROUP BY g, i
        ), proof AS (
            SELECT g, i, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY g, i
        )
        SELECT n.doc_id, n.leaf, t.subroot, crown.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = crown.root AS verified
        FROM n JOIN top t ON n.g = t.g CROSS JOIN crown JOIN last f ON f.g = n.g AND f.i = n.i LEFT JOIN proof p ON p.g = n.g AND p.i = n.i
    """,
    "op13_yinyang_codes": _lloyd_sql(),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
