"""A stored inverted index: postings in folders by token hash, kept up batch by batch.

Under one folder lie
* forward: a row per node with its digest, length and terms, joined by blanks, in buckets by node;
* postings: (token, node_id, f, dl, batch) in folders by token hash. A batch appends what it
  changes: a node's new counts, and a row with f 0 for each term it lost. Of a token and node the
  row of the latest batch holds;
* totals: per batch by how much the number of nodes and of terms grew.

A search reads the folders of its terms and the totals, never texts or other terms.
Document frequencies are the lengths of the lists it reads anyway. compact() drops rows that
later batches replaced.

A batch writes postings, then totals, each over what an earlier try of the same batch left,
and the forward table last; so a batch that failed and runs again ends in the same state, and
one that was finished changes nothing.

Defined results: null nodes are dropped, null contents are empty; of a repeated node the content
with the least digest counts; a node without terms counts in the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators.search import FLOOR, K1, MOST_TERMS, B
from sparquill.session import stored
from sparquill.sources import sinks

BUCKETS = 64


def _bucket(token: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _counted(nodes: DataFrame) -> DataFrame:
    """nodes with dl, terms, joined by blanks, which no term holds, and f, their counts."""

    def ends(terms: Column) -> Column:
        # equal terms stand together once sorted: the place of the last, less that of the one before, is the count
        placed = F.transform(terms, lambda t, i: F.struct(t.alias("token"), (i + 1).alias("end")))
        return F.filter(placed, lambda x: (x["end"] == F.size(terms)) | (F.try_element_at(terms, x["end"] + 1) != x["token"]))

    def counts(v: Column) -> Column:
        f = F.transform(v, lambda x, i: (x["end"] - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(v, i)["end"])).cast("int"))
        return F.struct(F.array_join(F.transform(v, lambda x: x["token"]), " ").alias("terms"), f.alias("f"))

    counted = X.bound(F.sort_array(X.index_terms("content")), lambda terms: F.struct(F.size(terms).alias("dl"), X.bound(ends(terms), counts).alias("c")))
    return nodes.withColumn("__n", counted).select(*[c for c in nodes.columns if c != "content"], "__n.dl", "__n.c.terms", "__n.c.f")


def _terms(column: str) -> Column:
    return F.filter(F.split(column, " "), lambda t: t != "")


def update(nodes: DataFrame, path: str, batch: int, buckets: int = BUCKETS, keep_missing: bool = True) -> int:
    """Index nodes (node_id, content) that are new or changed; gives how many changed. keep_missing False takes out those not among nodes.

    Contents are shuffled once, by node, to meet their digests; terms are counted of changed nodes alone.
    """
    spark = nodes.sparkSession
    forward, postings = f"{path}/forward", f"{path}/postings"
    told = nodes.where("node_id is not null").select("node_id", "content", X.short_hash("content").alias("content_hash")).repartition("node_id")
    now = told.groupBy("node_id").agg(F.min("content_hash").alias("content_hash"), F.min_by("content", "content_hash").alias("content"))
    had = sinks.read_buckets(spark, forward, buckets) if sinks.exists(spark, forward) else None
    gone = lost = None
    if had is None:
        new = stored(_counted(now.withColumn("known", F.lit(False))), "index-new")
    else:
        near = had
        if keep_missing:
            # nodes of this batch only, in their buckets
            ids = sorted(r[0] for r in nodes.where("node_id is not null").select(sinks.bucket_of("node_id", buckets)).distinct().collect())
            near = had.where(F.col(f"bucket_{buckets}").isin(ids))
        digests = near.select("node_id", F.col("content_hash").alias("had_hash"))
        differs = now.join(digests, "node_id", "left").where(~F.col("had_hash").eqNullSafe(F.col("content_hash")))
        new = stored(_counted(differs.withColumn("known", F.col("had_hash").isNotNull()).drop("had_hash")), "index-new")
        if not keep_missing:
            gone = stored(had.select("node_id", "dl", "terms").join(nodes.select("node_id"), "node_id", "left_anti"), "index-gone")
        known = new.where("known").select("node_id", F.col("terms").alias("new_terms"))
        replaced = sorted(r[0] for r in known.select(sinks.bucket_of("node_id", buckets)).distinct().collect())
        if replaced:
            old = near.where(F.col(f"bucket_{buckets}").isin(replaced)).select("node_id", "dl", "terms").join(known, "node_id")
            lost = old.select("node_id", "dl", F.array_except(_terms("terms"), _terms("new_terms")).alias("out"))
        if gone is not None:
            out = gone.select("node_id", "dl", _terms("terms").alias("out"))
            lost = out if lost is None else lost.unionByName(out)
        lost = lost if lost is None else stored(lost, "index-lost")
    changed = new.count() + (gone.count() if gone is not None else 0)
    if not changed:
        return 0
    listed = new.select("node_id", "dl", F.explode(F.arrays_zip(_terms("terms").alias("token"), F.col("f"))).alias("c"))
    rows = listed.select("c.token", "node_id", "c.f", "dl")
    grown = new.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("dl"), F.lit(0)).alias("terms"))
    if lost is not None:
        rows = rows.unionByName(lost.select(F.explode("out").alias("token"), "node_id", F.lit(0).alias("f"), F.lit(0).alias("dl")))
        less = lost.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t"))
        grown = grown.crossJoin(less).select((F.col("nodes") - F.col("n")).alias("nodes"), (F.col("terms") - F.col("t")).alias("terms"))  # a row each
    # sorted by token, so that row groups are passed over too
    rows = rows.repartition(_bucket("token", buckets), F.pmod(F.xxhash64("node_id"), F.lit(8)))
    rows = rows.withColumns({"batch": F.lit(batch).cast("long"), "bucket": _bucket("token", buckets)}).sortWithinPartitions("bucket", "token")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(postings)
    grown.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/totals")
    sinks.upsert_buckets(new.drop("known", "f"), forward, "node_id", batch=batch, buckets=buckets, gone=gone, distinct=True)
    return changed


def lists(spark: SparkSession, path: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(token, node_id, f, dl) of the terms as they are now."""
    wanted = list(dict.fromkeys(terms))[:MOST_TERMS]
    if not wanted or not sinks.exists(spark, f"{path}/postings"):
        return spark.createDataFrame([], "token string, node_id string, f int, dl int")
    numbers = spark.createDataFrame([(t,) for t in wanted], "t string").select(_bucket("t", buckets)).distinct().collect()
    read = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(sorted(r[0] for r in numbers)) & F.col("token").isin(wanted))
    latest = read.groupBy("token", "node_id").agg(F.max_by(F.struct("f", "dl"), "batch").alias("x"))
    return latest.select("token", "node_id", "x.*").where("f > 0")


def scores(spark: SparkSession, path: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(node_id, score) of nodes with any of the terms: BM25 as search.bm25 gives it."""
    found = lists(spark, path, terms, buckets)
    if not found.columns or not sinks.exists(spark, f"{path}/totals"):
        return found.select("node_id", F.lit(0.0).alias("score"))
    n, total = spark.read.parquet(f"{path}/totals").agg(F.sum("nodes"), F.sum("terms")).first()  # one row
    found = found.repartition("node_id")  # read twice, for frequencies and for scores
    df = found.groupBy("token").agg(F.count("*").cast("double").alias("df"))  # a row per term
    idf = F.ln((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(F.lit(FLOOR))
    length = F.lit(K1) * (1 - B + B * F.col("dl") / F.lit(total / n if n else 1.0))
    part = weight * F.col("f") * (K1 + 1) / (F.col("f") + length)
    return found.join(F.broadcast(df), "token").groupBy("node_id").agg(F.sum(part).alias("score"))


def search(spark: SparkSession, path: str, terms: list[str], top_k: int, buckets: int = BUCKETS) -> DataFrame:
    """The top_k nodes, ties by node."""
    return scores(spark, path, terms, buckets).orderBy(F.desc("score"), "node_id").limit(top_k)


def compact(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Rewrite postings and totals as one batch, the latest; searches read old files or new ones."""
    read = spark.read.parquet(f"{path}/postings")
    last = spark.read.parquet(f"{path}/totals").agg(F.max("batch")).first()[0]
    latest = read.groupBy("bucket", "token", "node_id").agg(F.max_by(F.struct("f", "dl"), "batch").alias("x")).select("bucket", "token", "node_id", "x.*").where("f > 0")
    latest = latest.withColumn("batch", F.lit(last)).repartition("bucket", F.pmod(F.xxhash64("node_id"), F.lit(8))).sortWithinPartitions("bucket", "token")
    sinks.replace(latest, f"{path}/postings", ["bucket", "batch"])
    totals = spark.read.parquet(f"{path}/totals").agg(*[F.sum(c).alias(c) for c in ("nodes", "terms")]).withColumn("batch", F.lit(last))
    sinks.replace(totals, f"{path}/totals", ["batch"])
