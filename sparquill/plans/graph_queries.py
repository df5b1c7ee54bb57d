"""Citation graph over order lines: an order cites the parts of its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.operators import graph as G
from sparquill.plans.registry import query
from sparquill.session import table


#: At least so many tasks hold the edges by source, so that a task's share stays small; Spark coalesces what has no number.
LEAST_PARTS = 200


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges, dealt by source once: duplicates go and scopes are met where they lie. Keys are made of distinct pairs."""
    parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    return lines.repartition(parts, "source_id").distinct().select("source_id", F.col("target_id").cast("string").alias("target_key"), "target_id")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"))


@query("""
    WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey = 1)
    SELECT l_partkey AS target_id, p_name AS title, p_size AS year FROM e LEFT JOIN part ON p_partkey = l_partkey
""")
def references_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.references_of(_edges(spark, sf_dir), _registry(spark, sf_dir), 1).select("target_id", "title", "year")


@query("""
    SELECT DISTINCT o_orderkey AS id, o_orderpriority AS kind FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 7 OR l_partkey = 8)
""")
def citing_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"))
    return G.citing(_edges(spark, sf_dir), orders, 7, "8")


@query("""
    SELECT l_partkey AS target_id, count(DISTINCT l_orderkey) AS n_sources FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 35
""")
def shared_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_references(_edges(spark, sf_dir), 35).select("target_id", "n_sources")


@query("""
    SELECT l_partkey AS target_id, count(DISTINCT l_orderkey) AS n_sources FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 12
""")
def shared_references_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source_id"))
    return G.shared_references(_edges(spark, sf_dir), 12, scope).select("target_id", "n_sources")


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders and large parts: the network within a workspace."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")).unionByName(table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"))).distinct()


_SCOPE = "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT p_partkey FROM part WHERE p_size > 25"


@query(f"""
    WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem), w AS ({_SCOPE})
    SELECT s AS source_id, t AS target_id FROM e WHERE s IN (SELECT id FROM w) AND t IN (SELECT id FROM w)
""")
def citation_network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.internal_edges(_edges(spark, sf_dir), _scope(spark, sf_dir)).select("source_id", "target_id")


@query(f"""
    WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem), w AS ({_SCOPE})
    SELECT w.id AS source_id, count(e.t) AS n_references, CAST(coalesce(sum(CASE WHEN e.t IN (SELECT id FROM w) THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_internal
    FROM w LEFT JOIN e ON e.s = w.id GROUP BY w.id
""")
def citation_network_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.network_sources(_edges(spark, sf_dir), _scope(spark, sf_dir))


@query(f"""
    WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem WHERE l_orderkey IN ({_SCOPE}))
    SELECT t AS target_id, s AS source_id FROM e WHERE t IN (SELECT t FROM e GROUP BY t HAVING count(*) >= 2)
""")
def citation_network_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each source of a shared target, so that no target's sources need fit in one row."""
    own = _edges(spark, sf_dir).join(_scope(spark, sf_dir).withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return own.join(G.shared_references(own, 2).select("target_id"), "target_id", "left_semi").select("target_id", "source_id")


@query(f"""
    WITH w AS ({_SCOPE}),
    x AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem WHERE l_orderkey IN (SELECT id FROM w))
    SELECT (SELECT count(*) FROM x) AS n_edges, (SELECT count(DISTINCT s) FROM x) AS n_sources,
           (SELECT count(*) FROM x WHERE t IN (SELECT id FROM w)) AS n_internal,
           (SELECT count(*) FROM (SELECT t FROM x GROUP BY t HAVING count(DISTINCT s) >= 2)) AS n_shared
""")
def citation_network_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.network_summary(_edges(spark, sf_dir), _scope(spark, sf_dir)).select("n_edges", "n_sources", "n_internal", "n_shared")


@query("""
    WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem),
    k AS (SELECT p_partkey FROM part WHERE p_size <= 25)
    SELECT count(*) AS n_edges, count(k.p_partkey) AS n_resolved FROM e LEFT JOIN k ON k.p_partkey = e.t
""")
def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("key"))
    return G.resolve(_edges(spark, sf_dir), known).agg(F.count("*").alias("n_edges"), F.count("target_id").alias("n_resolved"))


@query("""
    WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '10.1/' || o_custkey WHEN 1 THEN ' DOI:10.1/' || o_custkey WHEN 2 THEN 'https://doi.org/10.1/' || o_custkey END AS doi FROM orders)
    SELECT o_orderkey AS source_id, lower(regexp_replace(regexp_replace(trim(doi), '^(?i:doi:\\s*)', ''), '^(?i:https?://(dx\\.)?doi\\.org/)', '')) AS target_key FROM r
""")
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey").cast("string")
    doi = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("10.1/"), k)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" DOI:10.1/"), k)).otherwise(F.concat(F.lit("https://doi.org/10.1/"), k))
    return G.edges(o.select(F.col("o_orderkey").alias("source_id"), doi.alias("reference")))


@query("""
    SELECT p_partkey AS id, p_retailprice AS cited FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20
""")
def top_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("cited")).orderBy(F.desc("cited"), "id").limit(20)


@query("""
    SELECT o_orderkey AS id, c_name AS author, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE contains(lower(c_name), '#00000001') ORDER BY year(o_orderdate) DESC, o_orderkey LIMIT 50
""")
def search_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = table(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lit("#00000001"))).select("c_custkey", F.col("c_name").alias("author"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("string").alias("year"))
    return o.join(who, "c_custkey").select("id", "author", "year").orderBy(F.desc("year"), "id").limit(50)
