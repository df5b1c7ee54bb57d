"""Projections, text rules and streams that the other modules don't register."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import audit as A
from sparquill.operators import cards as C
from sparquill.operators import extraction as E
from sparquill.operators import headings as H
from sparquill.operators import identity as I
from sparquill.operators import reports as R
from sparquill.operators import workspace as W
from sparquill.plans.corpus_queries import _audited, _records
from sparquill.plans.registry import query
from sparquill.session import shared_dir, table
from sparquill.sources import library as L


@query("""
    WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
    p AS (SELECT doc_id, t, length(t) AS n, nullif(least(CASE WHEN instr(lower(t), 'license') > 0 THEN instr(lower(t), 'license') - 1 ELSE 1000000000 END, CASE WHEN instr(lower(t), 'heit') > 0 THEN instr(lower(t), 'heit') - 1 ELSE 1000000000 END), 1000000000) AS hit FROM c),
    s AS (SELECT *, greatest(0, coalesce(hit, 0) - 40) AS s0 FROM p), e AS (SELECT *, least(n, s0 + 120) AS e0 FROM s), w AS (SELECT *, greatest(0, e0 - 120) AS b0 FROM e)
    SELECT doc_id, CASE WHEN n <= 120 THEN t ELSE (CASE WHEN b0 > 0 THEN '...' ELSE '' END) || trim(substring(t, CAST(b0 + 1 AS INT), CAST(e0 - b0 AS INT))) || (CASE WHEN e0 < n THEN '...' ELSE '' END) END AS snippet FROM w
""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet("text", ["license", "heit"], 120).alias("snippet"))


@query("""
    SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS pmid FROM orders
""")
def pmid_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    raw = F.when(n == 0, F.concat(F.lit(" PMID: "), k)).when(n == 1, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), k, F.lit("/"))).when(n == 2, k).otherwise(F.concat(k, F.lit("x")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.normalize_pmid(raw).alias("pmid"))


@query("""
    SELECT c_custkey AS id, concat_ws(chr(10), 'Title: ' || c_name, CASE WHEN c_custkey % 2 = 0 THEN 'Authors: ' || c_mktsegment END, 'Year: ' || c_nationkey) AS node FROM customer
""")
def metadata_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("authors"), F.lit(None).cast("string").alias("journal"), F.col("c_nationkey").alias("year"))
    return c.select("id", L.metadata_node().alias("node"))


@query("""
    SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE greatest(p_size, p_partkey % 70) END AS citations,
           CASE WHEN p_partkey % 5 = 0 THEN '[No abstract available]' ELSE p_type END AS abstract, p_brand || chr(10) || 'high' || chr(10) || p_type AS card FROM part
""")
def layer_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best citation, abstract with its default, and a card flattened for the index."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    counts = F.when(k % 3 != 0, F.create_map(F.lit("a"), F.col("p_size").cast("long"), F.lit("b"), k % 70))
    l3 = F.struct(F.col("p_brand").alias("takeaway"), F.lit("high").alias("confidence"), F.lit("").alias("mode"), F.array("p_type").alias("key_findings"), F.lit(None).cast("array<string>").alias("limitations"))
    made = p.select(k.alias("id"), k.cast("string").alias("dir_name"), counts.alias("citation_count"), F.when(k % 5 == 0, " ").otherwise(F.col("p_type")).alias("abstract"), l3.alias("l3"))
    cited = made.select("dir_name", "id", L.best_citation("citation_count").alias("citations"))
    return cited.join(L.layer2(made), "dir_name").join(L.layer3(made), "dir_name").select("id", "citations", "abstract", "card")


@query("""
    SELECT l_orderkey AS item_id, max(CASE WHEN l_linenumber = 1 THEN CAST(l_partkey AS VARCHAR) END) AS title, max(CASE WHEN l_linenumber = 2 THEN CAST(l_partkey AS VARCHAR) END) AS date,
           string_agg(CAST(l_suppkey AS VARCHAR), ';' ORDER BY l_linenumber, l_suppkey) AS authors
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CAST(l_partkey AS VARCHAR)) = 1)
    WHERE l_orderkey % 7 <> 0 GROUP BY l_orderkey
""")
def eav_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as entity, attribute and value; each seventh order is deleted.

    Of lines with the same order and number that with the least part as text counts, and of those with
    the same part, which the SQL leaves open, that with the greatest supplier.
    """
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    one = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(F.col("l_partkey").cast("string").alias("p"), (-F.col("l_suppkey")).alias("s"))).alias("x"))
    items = one.select(F.col("l_orderkey").alias("item_id")).distinct()
    data = one.select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("field_id"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("value_id"))
    values = one.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("value_id"), F.col("x.p").alias("value"))
    fields = spark.createDataFrame([(1, "title"), (2, "date")], "field_id int, field_name string")
    creators = one.select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("order_index"), F.lit(None).cast("string").alias("first_name"), (-F.col("x.s")).cast("string").alias("last_name"))
    deleted = items.where("item_id % 7 = 0")
    return L.items_from_eav(items, data, values, fields, creators, deleted, ["title", "date"]).select("item_id", "title", "date", F.array_join("authors", ";").alias("authors"))


@query("SELECT n_nationkey AS collection_id, n_name AS name, count(c_custkey) AS n_items FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("collection_id"), F.col("c_custkey").alias("item_id"))
    return L.collections_with_counts(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("collection_id"), F.col("n_name").alias("name")), members)


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS seconds FROM orders GROUP BY o_orderstatus")
def step_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("seconds"))


@query("""
    WITH w AS (SELECT o_orderkey AS pos, o_custkey AS id FROM orders), r AS (SELECT c_custkey AS id, c_name AS dir_name FROM customer)
    SELECT w.pos, w.id, r.dir_name, c_mktsegment AS journal, CASE WHEN w.id % 3 = 0 THEN 'full_text' ELSE 'metadata_only' END AS full_text_status FROM w JOIN r USING (id) JOIN customer ON c_name = r.dir_name
""")
def workspace_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the registry's current name, the record and its full-text status."""
    c = table(spark, sf_dir, "customer")
    entries = table(spark, sf_dir, "orders").select(F.lit("w").alias("ws"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("id"), F.lit("old name").alias("dir_name"))
    registry = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("dir_name"))
    papers = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("dir_name"), F.col("c_mktsegment").alias("journal"))
    texts = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("dir_name"))
    return W.evidence(entries, registry, papers, texts).select("pos", "id", "dir_name", "journal", "full_text_status")


@query("SELECT doc_id AS ws, 'F1' AS figure, CASE WHEN doc_id % 2 = 0 THEN 'complete' ELSE 'missing' END AS status FROM documents UNION ALL SELECT doc_id, 'F2', 'missing' FROM documents")
def figure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ws"))
    plans = d.withColumn("text", F.lit("# Plan\n\n## Figures\n| F1 | one |\n| F2 | two |\n## Notes\n| F3 | no |"))
    manifest = d.where("ws % 2 = 0").select(F.concat_ws("/", F.col("ws").cast("string"), F.lit("F1")).alias("figure"), F.concat(F.lit("/f/"), F.col("ws").cast("string")).alias("path"))
    planned = W.planned_figures(plans).select("ws", F.col("figure").alias("name"), F.concat_ws("/", F.col("ws").cast("string"), "figure").alias("figure"))
    return W.figure_status(planned, manifest, manifest.select("path")).select("ws", F.col("name").alias("figure"), "status")


@query("""
    SELECT doc_id, '10.' || (1000 + doc_id) || '/X.' || doc_id AS doi, CAST(2000 + doc_id % 24 AS INTEGER) AS year,
           CASE WHEN doc_id % 4 = 0 THEN 'patent' WHEN doc_id % 4 = 1 THEN 'thesis' WHEN doc_id % 4 = 2 THEN 'book' END AS kind FROM documents
""")
def text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier, year and type from text made inside the query."""
    k = F.col("doc_id")
    s = k.cast("string")
    text = F.concat(F.lit("data 10.5281/zenodo.1 and [doi:10."), (k + 1000).cast("string"), F.lit("/X."), s, F.lit("]. Copyright © "), (k % 24 + 2000).cast("string"))
    title = F.when(k % 4 == 1, "Doctoral dissertation").when(k % 4 == 2, "A Handbook").otherwise("Plain")
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"), title.alias("title"), F.when(k % 4 == 0, "CN1").alias("publication_number"), F.lit("").alias("paper_type"))
    return d.select("doc_id", E.doi_in_text("t").alias("doi"), E.year_in_text("t").alias("year"), E.document_type("title", "paper_type", "publication_number", "t").alias("kind"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AS wanted FROM orders")
def needs_refetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).withColumn("k", F.col("id").cast("long")).withColumn("publisher", F.when(F.col("k") % 2 != 0, "P")).withColumn("references", F.array(F.lit("r")))
    r = r.withColumn("citation_count", F.when(F.col("k") % 3 != 0, F.create_map(F.lit("a"), F.lit(1))))
    return r.select("id", E.needs_refetch().alias("wanted"))


@query("SELECT doc_id, 'Jimenez-' || (2000 + doc_id % 24) || '-' || source || '-of-' || lang AS stem FROM documents")
def directory_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("Jiménez").alias("first_author_lastname"), (F.lit(2000) + F.col("doc_id") % 24).cast("int").alias("year"), F.concat(F.lit("$"), "source", F.lit("$ of: "), "lang", F.lit("!")).alias("title"))
    return E.with_stem(d).select("doc_id", "stem")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'skipped' WHEN doc_id % 3 = 1 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN doc_id % 3 = 2 THEN 'no_conclusion' END AS reason, CASE WHEN doc_id % 3 = 1 THEN 'However, ' || n_chars || ' samples of ' || lang || ' are few, and more than that would be needed to say so for good.' END AS takeaway FROM documents")
def conclusion_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    body = F.concat(F.lit("However, "), F.col("n_chars").cast("string"), F.lit(" samples of "), "lang", F.lit(" are few, and more than that would be needed to say so for good."))
    md = F.concat(F.lit("# T\n## 1 Results\nx\n## "), F.when(k % 3 == 2, "Other").otherwise("5 Conclusion"), F.lit("\n"), body, F.lit("\n## References\n[1]"))
    d = table(spark, sf_dir, "documents").select("doc_id", md.alias("md"), F.when(k % 3 == 0, "book").otherwise("review").alias("kind"))
    return C.cards(d, "doc_id", "md", "kind").select("doc_id", "status", "reason", F.col("card.takeaway").alias("takeaway"))


@query("""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+', '-', 'g'), '-') AS slug FROM documents)
    SELECT doc_id, md5(CASE WHEN slug = '' THEN 'section' ELSE slug END) AS slug,
           contains(lower(text), 'abstract is not available') OR contains(lower(text), 'preview has been provided') OR contains(lower(text), 'access link') AS boilerplate
    FROM t
""")
def small_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs (as digests) of whole texts, and which hold a publisher's notice."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.slug("text").cast("binary")).alias("slug"), X.is_boilerplate("text").alias("boilerplate"))


@query("""
    SELECT page_id, CASE WHEN name = '' THEN 'query' ELSE name END AS run_name
    FROM (SELECT page_id, lower(substr(trim(regexp_replace(trim(coalesce(url, '')), '[^A-Za-z0-9\\x{3400}-\\x{9FFF}]+', '-', 'g'), '-'), 1, 48)) AS name FROM pages)
""")
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.run_name("url").alias("run_name"))


@query("""
    WITH t AS (SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) AS x FROM conversations),
    w AS (SELECT *, list_distinct(string_split(x, ' ')) AS w FROM t)
    SELECT a.conv_id, a.turn, (a.x <> '' AND b.x <> '' AND (contains(a.x, b.x) OR contains(b.x, a.x) OR len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w), 1) > 0.1)) AS alike
    FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the next one, whole texts."""
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.select("conv_id", "turn", "text").join(after, ["conv_id", "turn"]).select("conv_id", "turn", X.similar_titles("text", "next", 0.1).alias("alike"))


@query("""
    SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
               '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\*\\*\\*([^*]+)\\*\\*\\*', '\\1', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g'), '__([^_]+)__', '\\1', 'g'), '`([^`]+)`', '\\1', 'g')) AS plain,
           md5(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '(?i)<img\\b[^>]*>', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS no_images
    FROM pages
""")
def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of whole pages without inline marks, and without images."""
    digest = lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", digest(X.strip_inline("html")).alias("plain"), digest(X.strip_images("html")).alias("no_images"))


@query()
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a page's title and headings stand among the lines that its tags part it into."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", "\n").alias("text"), F.regexp_extract_all("html", F.lit("(?i)<(?:title|h[1-6])[^>]*>([^<]+)</"), F.lit(1)).alias("c"))
    return H.locate(p, p.select("page_id", F.explode("c").alias("candidate")), "page_id")


@query("""
    WITH w AS (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM benchmark), c AS (SELECT regexp_replace(lower(w), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') AS word FROM w),
    k AS (SELECT word, count(*) AS n FROM c WHERE length(word) >= 2 AND word NOT IN ('the', 'of') GROUP BY word ORDER BY n DESC, word LIMIT 10),
    r AS (SELECT coalesce(c_name, CAST(user_id AS VARCHAR)) AS title, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1 ORDER BY n DESC, title LIMIT 10)
    SELECT 'keyword' AS section, word AS key, n FROM k UNION ALL SELECT 'read', title, n FROM r UNION ALL SELECT 'week', strftime(ts, '%Y-W%W'), count(*) FROM events GROUP BY 2
""")
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("name", F.col("user_id"))
    titles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.col("c_name").alias("title"))
    return R.insights(e, table(spark, sf_dir, "benchmark"), titles, "text", ("the", "of"))


@query("""
    WITH RECURSIVE e AS (
        SELECT c_custkey AS id, c_name AS title, 'P' || c_custkey AS pmid, -1 AS pos FROM customer UNION ALL SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderkey FROM orders
    ), runs AS (
        SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY pos) AS run
        FROM (SELECT *, CASE WHEN lag(pmid) OVER (PARTITION BY id ORDER BY pos) = pmid THEN 0 ELSE 1 END AS starts FROM e)
    ), ends AS (
        SELECT id, run, lead(min(pos)) OVER (PARTITION BY id ORDER BY run) AS until FROM runs GROUP BY id, run
    ), tries AS (
        SELECT r.id, r.pmid, r.pos, n.until FROM runs r JOIN ends n ON r.id = n.id AND r.run = n.run
    ), held AS (
        SELECT pmid, arg_min(id, pos) AS id, arg_min(until, pos) AS until, min(pos) AS pos FROM (SELECT pmid, id, coalesce(until, 9223372036854775807) AS until, pos FROM tries) GROUP BY pmid
        UNION ALL
        SELECT h.pmid, t.id, coalesce(t.until, 9223372036854775807), t.pos
        FROM held h JOIN tries t ON t.pmid = h.pmid AND t.pos > h.until
        QUALIFY row_number() OVER (PARTITION BY h.pmid ORDER BY t.pos) = 1
    ), l AS (
        SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1
    )
    SELECT l.id, l.title, CASE WHEN h.id IS NULL THEN '' ELSE l.pmid END AS pmid
    FROM l LEFT JOIN held h ON h.pmid = l.pmid AND h.id = l.id AND h.until = 9223372036854775807
""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a registry; each order rewrites its customer's record."""
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("pmid"))
    incoming = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("pmid"), F.col("o_orderkey").alias("pos"))
    return I.upsert_registry(registry, incoming, keys=("pmid",)).select("id", "title", "pmid")


@query("SELECT p_partkey AS id, p_size AS year, p_name AS dir_name FROM part")
def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.listing(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("year"), F.col("p_name").alias("dir_name")))


@query("SELECT url, max(page_id) AS page_id FROM pages GROUP BY url")
def last_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.last_of(table(spark, sf_dir, "pages").select("url", "page_id"), "url", "page_id")


@query()
def reference_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reference_map(_records(spark, sf_dir)).select("id", "citekey")


@query()
def audit_errors_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.in_order(A.issues(_audited(spark, sf_dir)).where("severity = 'error'"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily counts by a stream over what is there; its table holds a row per window and type."""
    from sparquill.streaming import incremental as S

    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").parquet(f"{sf_dir}/events.parquet*")
    name = f"daily_{uuid.uuid4().hex}"
    found = S.run_to_table(S.windowed_counts(stream, "1 day"), name, f"{shared_dir(spark)}/{name}", "complete")
    return found.select(F.col("started").cast("timestamp_ntz").alias("started"), "event_type", "n")
