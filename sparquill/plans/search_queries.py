"""Search over documents and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import inverted
from sparquill.operators import nodes as N
from sparquill.operators import proximity as P
from sparquill.operators import search as S
from sparquill.plans.registry import query
from sparquill.session import shared_dir, table

QUERY = "the tion and heit queche"
TERMS = S.query_tokens(QUERY)
REQUIRE = ["the"]

_TOKENS = "list_distinct(list_transform(regexp_extract_all({col}, '[A-Za-z0-9_]+'), lambda x: lower(x)))"


def _bm25_sql(terms: list[str], condition: str = "TRUE", require: list[str] | None = None, mode: str = "or", top: int = 20, extra: str = "TRUE") -> str:
    require = require or []
    every = list(dict.fromkeys([*terms, *require]))
    weight = {t: (t in terms) + (t in require) for t in every}
    needed = every if mode == "and" else require
    parts = " + ".join(
        f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) ELSE 1e-6 END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / mean)) * {weight[t]}"
        for i, t in enumerate(every)
    )
    counts = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(every))
    df = ", ".join(f"CAST(count(*) FILTER (f{i} > 0) AS DOUBLE) AS df{i}" for i in range(len(every)))
    must = " AND ".join([f"f{every.index(t)} > 0" for t in needed] + ["TRUE"])
    some = " OR ".join(f"f{every.index(t)} > 0" for t in terms)
    return f"""
        WITH t AS (SELECT doc_id, lang, source, text, list_filter(flatten(list_transform({_TOKENS.format(col="text")}, lambda x: string_split(x, '_'))), lambda x: x <> '') AS tokens FROM documents),
        l AS (SELECT doc_id, lang, source, text, len(tokens) AS dl, {counts} FROM t),
        s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS mean, {df} FROM l)
        SELECT doc_id AS paper_id, round({parts}, 6) AS score
        FROM l, s
        WHERE ({some}) AND {must} AND {condition} AND {extra}
        ORDER BY {parts} DESC, doc_id LIMIT {top}
    """


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one node each."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("node_id"), F.col("doc_id").alias("paper_id"), F.lit(1).alias("ordinal"), F.col("text").alias("content"), "lang", "source")


def turn_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as nodes: the conversation is the paper, the turn the ordinal, the role the section."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("node_id"), F.col("conv_id").alias("paper_id"), F.col("turn").alias("ordinal"), F.col("role").alias("section"), F.col("text").alias("content"))


def _scores(hits: DataFrame) -> DataFrame:
    return hits.select("paper_id", F.round("score", 6).alias("score"))


@query(_bm25_sql(TERMS))
def bm25_search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(S.search_nodes(document_nodes(spark, sf_dir), QUERY, 20, fallback=False))


@query(_bm25_sql(["the", "tion"], mode="and"))
def bm25_search_and_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(S.search_nodes(document_nodes(spark, sf_dir), "the tion", 20, mode="and", fallback=False))


@query(_bm25_sql(TERMS, require=REQUIRE))
def bm25_search_require(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(S.search_nodes(document_nodes(spark, sf_dir), QUERY, 20, require=REQUIRE, fallback=False))


@query(_bm25_sql(TERMS, condition="lang = 'en' AND contains(lower(source), 'src1')"))
def bm25_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = (F.col("lang") == "en") & F.contains(F.lower("source"), F.lit("src1"))
    return _scores(S.search_nodes(document_nodes(spark, sf_dir), QUERY, 20, where=narrow, fallback=False))


@query(_bm25_sql(TERMS, extra="doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def bm25_search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("paper_id"))
    return _scores(S.search_nodes(document_nodes(spark, sf_dir), QUERY, 20, scope=scope, fallback=False))


@query(f"WITH hits AS ({_bm25_sql(TERMS)}) SELECT h.paper_id, h.score FROM hits h JOIN documents d ON d.doc_id = h.paper_id WHERE NOT contains(lower(d.text), 'license')")
def bm25_search_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excluded word is tested after the limit."""
    return _scores(S.search_nodes(document_nodes(spark, sf_dir), QUERY, 20, exclude=["license"], fallback=False))


@query(_bm25_sql(TERMS))
def bm25_from_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_nodes(spark, sf_dir)
    scored = S.bm25_from_postings(S.postings(d, F.col("content")), S.node_stats(d, F.col("content")), TERMS)
    return scored.orderBy(F.desc("score"), "node_id").limit(20).select(F.col("node_id").alias("paper_id"), F.round("score", 6).alias("score"))


@query(_bm25_sql(TERMS))
def stored_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index kept in two batches, English documents and then all, and searched by its postings alone."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    d = document_nodes(spark, sf_dir)
    inverted.update(d.where("lang = 'en'"), path, 0)
    inverted.update(d, path, 1)
    return inverted.search(spark, path, TERMS, 20).select(F.col("node_id").alias("paper_id"), F.round("score", 6).alias("score"))


@query("""
    SELECT doc_id AS paper_id, CAST(-999.0 AS DOUBLE) AS score FROM documents
    WHERE contains(lower(text), 'licensed under') ORDER BY doc_id LIMIT 20
""")
def like_fallback_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.like_scan(document_nodes(spark, sf_dir), ["licensed under"])
    return found.orderBy("paper_id", "ordinal").limit(20).select("paper_id", F.lit(-999.0).alias("score"))


@query(f"""
    WITH t AS (SELECT doc_id, {_TOKENS.format(col="text")} AS tokens FROM documents),
    p AS (SELECT unnest(tokens) AS token FROM t)
    SELECT token, count(*) AS df FROM p GROUP BY token
""")
def posting_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_nodes(spark, sf_dir)
    post = d.select(F.explode(X.ascii_tokens("content")).alias("token"))
    return post.groupBy("token").agg(F.count("*").alias("df"))


_TURNS = """
    n AS (SELECT conv_id || ':' || lpad(CAST(turn AS VARCHAR), 4, '0') AS node_id, conv_id, turn, role, text,
                 (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) AS hit, length(text) AS len FROM conversations),
    r AS (SELECT *, row_number() OVER (ORDER BY len DESC, conv_id, turn) AS rank FROM n WHERE hit = 1 QUALIFY row_number() OVER (ORDER BY len DESC, conv_id, turn) <= 80)
"""


def _turn_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 80 longest turns with a word, ranked: stands for node hits, at most a page."""
    n = turn_nodes(spark, sf_dir).where(F.contains(F.lower("content"), F.lit("the")))
    top = n.withColumn("len", F.length("content")).orderBy(F.desc("len"), "paper_id", "ordinal").limit(80)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("len"), "paper_id", "ordinal")))


@query(f"""
    WITH {_TURNS}, g AS (
        SELECT conv_id AS paper_id, sum(1.0 / (60 + rank)) AS s, count(*) AS hits, min(rank) AS best,
               array_to_string(list_slice(list(node_id ORDER BY rank), 1, 3), ',') AS evidence
        FROM r GROUP BY conv_id)
    SELECT paper_id, round(s, 9) AS score, hits, evidence FROM g ORDER BY s DESC, best LIMIT 20
""")
def evidence_rollup_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = S.roll_up(_turn_hits(spark, sf_dir).withColumn("snippet", F.lit("")), 20)
    return rolled.select("paper_id", F.round("score", 9).alias("score"), "hits", F.array_join(F.transform("evidence", lambda e: e["node_id"]), ",").alias("evidence"))


@query("""
    SELECT conv_id AS paper_id, turn AS ordinal,
           conv_id || ':' || lpad(CAST(turn AS VARCHAR), 4, '0') AS node_id,
           lag(conv_id || ':' || lpad(CAST(turn AS VARCHAR), 4, '0')) OVER w AS prev_id,
           lead(conv_id || ':' || lpad(CAST(turn AS VARCHAR), 4, '0')) OVER w AS next_id
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def node_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("ordinal"))
    return N.linked(turns).select("paper_id", "ordinal", "node_id", "prev_id", "next_id")


@query("""
    SELECT conv_id || ':' || lpad(CAST(turn AS VARCHAR), 4, '0') AS node_id, conv_id AS paper_id, turn AS ordinal, length(text) AS pos FROM conversations WHERE contains(lower(text), 'the')
""")
def nodes_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a word, fetched by id in order of length."""
    turns = turn_nodes(spark, sf_dir)
    wanted = turns.where(F.contains(F.lower("content"), F.lit("the"))).select("node_id", F.length("content").alias("pos"))
    return N.by_ids(turns, wanted).select("node_id", "paper_id", "ordinal", "pos")


@query("""
    WITH r AS (SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the'))
    SELECT n.conv_id AS paper_id, n.turn AS ordinal, min(r.turn) AS rank FROM r JOIN conversations n ON n.conv_id = r.conv_id AND n.turn BETWEEN r.turn - 1 AND r.turn + 1 GROUP BY n.conv_id, n.turn
""")
def neighbor_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with a word, in reading order, and its neighbours."""
    turns = turn_nodes(spark, sf_dir)
    hits = turns.where(F.contains(F.lower("content"), F.lit("the"))).withColumn("rank", F.col("ordinal"))
    return N.with_neighbours(turns, hits, 1).select("paper_id", "ordinal", "rank")


@query(f"""
    WITH {_TURNS}, e AS (SELECT r.conv_id, min(r.rank) AS rank, n.turn, any_value(n.text) AS text FROM r JOIN n ON n.conv_id = r.conv_id AND n.turn BETWEEN r.turn - 1 AND r.turn + 1 GROUP BY r.conv_id, n.turn),
    b AS (SELECT *, sum(length(left(text, 6000))) OVER (ORDER BY rank, turn ROWS UNBOUNDED PRECEDING) AS used FROM e)
    SELECT conv_id AS paper_id, turn AS ordinal, rank, CAST(used AS BIGINT) AS used FROM b WHERE used <= 5000
""")
def research_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.bundle(turn_nodes(spark, sf_dir), _turn_hits(spark, sf_dir), budget=5000).select("paper_id", "ordinal", "rank", "used")


@query("""
    WITH b AS (SELECT conv_id, turn, length(text) AS len, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
    SELECT conv_id AS paper_id, turn AS ordinal, CAST(used AS BIGINT) AS used FROM b WHERE used <= 400
""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = N.within_budget(turn_nodes(spark, sf_dir), ["ordinal"], F.length("content"), 400, ["paper_id"])
    return kept.select("paper_id", "ordinal", "used")


@query("""
    WITH b AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
    SELECT conv_id AS paper_id, turn AS ordinal, md5(substring(text, 1, CAST(300 - before AS INT))) AS digest FROM b WHERE before < 300
""")
def budget_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = N.cut_to_budget(turn_nodes(spark, sf_dir), ["ordinal"], "content", 300, ["paper_id"])
    return kept.select("paper_id", "ordinal", F.md5("content").alias("digest"))


@query("""
    SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE trim(b.text) <> ''
""")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text whole.

    An item is keyed by its longest inner word, which a document that holds it has between
    spaces too, so the texts meet on equal keys and are then compared. An item without inner
    words is keyed by each word of the documents that holds its own longest word; those words
    are found among the distinct ones, by their grams. Blank items are in no document.
    """
    longest = lambda words: F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    words = F.split("item", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item")).withColumns({"key": F.nullif(longest(inner), F.lit("")), "word": longest(words)})
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("key"))
    short = items.where("key is null and word <> ''").select("item_id", "item", "word", F.substring("word", 1, X.GRAM).alias("gram"))
    known = seen.select("key").where("key <> ''").distinct().select("key", F.explode(X.grams("key")).alias("gram"))
    spread = short.join(known, "gram").where(F.contains("key", F.col("word")))
    keyed = items.where("key is not null").select("item_id", "item", "key").unionByName(spread.select("item_id", "item", "key"))
    pairs = seen.join(keyed, "key").select("doc_id", "item_id", "item")
    return docs.join(pairs, "doc_id").where(F.contains("text", F.col("item"))).select("item_id", "doc_id").distinct()


@query("""
    WITH a AS (
        SELECT 'documents' AS scope, CAST(doc_id AS VARCHAR) AS id, length(text) AS score FROM documents WHERE contains(text, 'the')
        UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), length(text) FROM benchmark WHERE contains(text, 'the')
        UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), length(html) FROM pages WHERE contains(html, 'the')),
    r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, id) AS rank FROM a)
    SELECT scope, id, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
""")
def federated_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten of each scope, not fused: a top-k per scope, then a rank over few rows."""
    parts = []
    for scope, key, text in (("documents", "doc_id", "text"), ("benchmark", "item_id", "text"), ("pages", "page_id", "html")):
        own = table(spark, sf_dir, scope).where(F.contains(text, F.lit("the"))).select(F.lit(scope).alias("scope"), F.col(key).cast("string").alias("id"), F.length(text).alias("score"))
        parts.append(own.orderBy(F.desc("score"), "id").limit(10))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), "id")))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("n_chars", F.length("content"))


@query()
def cjk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of texts that hold CJK runs, made inside the query as the tables have none."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("深度 学习, "), "lang", F.lit(" 模型 a_b "), F.col("source"), F.lit(" 한국")).alias("text"))
    return d.select("doc_id", F.array_join(X.index_tokens("text"), " ").alias("tokens"))


@query()
def silo_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silo grammar: a phrase and a word, without another."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("authors"), F.col("text").alias("abstract"))
    return S.silo_search(d, '"of the" AND (tion OR heit) NOT license', 20, key="doc_id").select("doc_id", F.round("score", 6).alias("score"))


_TOKENS = """regexp_extract_all(translate(regexp_replace(lower(coalesce(text, '')), '\\p{M}+', '', 'g'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+')"""
_NEAR_SQL = f"""
    WITH t AS (SELECT doc_id, {_TOKENS} AS ws FROM documents),
    e AS (SELECT doc_id, unnest(ws) AS w, unnest(ws[2:] || ['']) AS after, unnest(range(len(ws))) AS pos FROM t),
    s AS (SELECT doc_id, pos, CASE WHEN w = 'tion' THEN 1 ELSE 2 END AS n, w = 'tion' AS one FROM e WHERE w = 'tion' OR (w = 'of' AND after = 'the')),
    l AS (SELECT doc_id, pos, one, lag(one) OVER v AS was, lag(pos + n) OVER v AS ended FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY pos))
    SELECT DISTINCT doc_id FROM l WHERE one <> was AND pos - ended <= 5
"""


@query(_NEAR_SQL)
def silo_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a word near a phrase, by the silo grammar over whole texts."""
    return table(spark, sf_dir, "documents").where(S.expression_filter('NEAR("of the" tion, 5)', ["text"])).select("doc_id")


@query(_NEAR_SQL)
def near_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from postings with positions."""
    post = P.positions(table(spark, sf_dir, "documents"), ["text"], "doc_id")
    return P.near_from_positions(post, *P.parse_near('"of the" tion, 5')).select(F.col("node_id").alias("doc_id"))
