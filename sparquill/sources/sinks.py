"""Writing: staged swaps, incremental upserts, appends, artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.session import stored


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def replace(df: DataFrame, path: str, folders: list[str] | None = None) -> None:
    """Write beside the target, then swap directories: readers see the old table or the new one."""
    spark = df.sparkSession
    fs, target = _files(spark, path)
    tag = uuid.uuid4().hex[:8]
    _, staged = _files(spark, f"{path}.new-{tag}")
    _, old = _files(spark, f"{path}.old-{tag}")
    df.write.partitionBy(*folders or []).parquet(staged.toString())
    had = fs.exists(target)
    if had:
        fs.rename(target, old)
    if not fs.rename(staged, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"could not move the new table to {path}")
    if had:
        fs.delete(old, True)


def changed(incoming: DataFrame, stored: DataFrame, key: str = "paper_id", digest: str = "content_hash") -> DataFrame:
    """Rows that are new or whose digest differs."""
    return incoming.join(stored.select(key, digest), [key, digest], "left_anti")


def upsert(incoming: DataFrame, stored: DataFrame, key: str = "paper_id", digest: str = "content_hash", keep_missing: bool = True) -> DataFrame:
    """The table after an incremental pass: changed rows replace their predecessors.

    keep_missing False also drops rows whose key no longer comes in.
    """
    new = changed(incoming, stored, key, digest)
    rest = stored.join(new.select(key), key, "left_anti")
    if not keep_missing:
        rest = rest.join(incoming.select(key), key, "left_semi")
    return rest.unionByName(new.select(*stored.columns))


BUCKETS = 64


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The table of upsert_buckets, its bucket as bucket_<buckets>; ValueError if it was written with another number."""
    found = spark.read.parquet(path)
    if f"bucket_{buckets}" not in found.columns:
        raise ValueError(f"{path} has other buckets than {buckets}")
    return found


def upsert_buckets(incoming: DataFrame, path: str, key: str = "paper_id", digest: str = "content_hash", batch: int = 0, buckets: int = BUCKETS, gone: DataFrame | None = None, distinct: bool = False) -> int:
    """Upsert rows into a table in folders by hash of the key; a batch whose keys are all new is appended, else folders with changed rows are read whole and written. Gives how many folders.

    Rows whose digest is stored are skipped, so that a batch that comes again writes nothing;
    rows that are written carry the batch's number. gone (key) names rows to take out. Null
    keys are dropped, of a repeated key the row with the least digest counts; distinct says that there
    are none of either, and that incoming is a stored table. The number of buckets
    belongs to the table: choose it so that a bucket fits a few tasks.
    """
    spark, name = incoming.sparkSession, f"bucket_{buckets}"
    rows = incoming
    if not distinct:
        first = Window.partitionBy(key).orderBy(digest)
        rows = incoming.where(F.col(key).isNotNull()).withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    rows = rows.withColumns({"batch": F.lit(batch).cast("long"), name: bucket_of(key, buckets)})
    if not exists(spark, path):
        rows.repartition(name).write.partitionBy(name).parquet(path)
        return buckets
    table = read_buckets(spark, path, buckets)
    # at most `buckets` numbers each
    numbers = lambda df: sorted(r[0] for r in df.select(name).distinct().collect())
    rows = rows if distinct else stored(rows, "upsert-batch")
    out = stored(gone.select(F.col(key)).distinct().withColumn(name, bucket_of(key, buckets)), "upsert-gone") if gone is not None else None
    near = table.where(F.col(name).isin(numbers(rows)))
    met = stored(rows.select(key, name, digest).join(near.select(key, F.col(digest).alias("__had")), key), "upsert-met")  # keys that the table has
    same = met.where(F.col("__had") == F.col(digest)).select(key)
    new = rows.join(same, key, "left_anti") if not same.isEmpty() else rows
    touched = set(numbers(new))
    rewritten = set(numbers(met.join(same, key, "left_anti")))
    if out is not None:
        old = table.where(F.col(name).isin(numbers(out))).select(key, name)
        rewritten |= set(numbers(old.join(out.select(key), key, "left_semi")))
    touched |= rewritten
    if not touched:
        return 0
    # one write in either case, so that a batch is there or isn't
    if not rewritten:
        new.select(*table.columns).repartition(name).write.mode("append").partitionBy(name).parquet(path)
        return len(touched)
    going = new.select(key) if out is None else new.select(key).unionByName(out.select(key))
    rest = table.where(F.col(name).isin(sorted(touched))).join(going, key, "left_anti")
    merged = stored(rest.unionByName(new.select(*table.columns)), "upsert-merged")
    empty = touched - set(numbers(merged))
    merged.repartition(name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    for b in empty:  # a folder that lost its last row isn't in what was written
        fs, place = _files(spark, f"{path}/{name}={b}")
        fs.delete(place, True)
    return len(touched)


def append_new(incoming: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose key the table doesn't have; repeated keys within the batch go too."""
    spark = incoming.sparkSession
    fresh = incoming.dropDuplicates(keys)
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)


def split_pending(decided: DataFrame, accepted: str, pending: str, batch: int | None = None) -> None:
    """Ingested records to one table, the others with their issue to another; a batch's rows replace what it wrote before."""
    kept, other = decided.where("status = 'ingested'").drop("issue", "duplicate_of"), decided.where("status <> 'ingested'")
    for rows, path in ((kept, accepted), (other, pending)):
        if batch is None:
            rows.write.mode("append").parquet(path)
        else:
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def joined_text(df: DataFrame, column: str, order: list[str], separator: str = "\n\n") -> str:
    """One text from few rows, for an export file: rows are sorted by Spark and streamed to the driver."""
    parts = [r[0] for r in df.orderBy(*order).select(column).toLocalIterator()]
    return separator.join(parts) + "\n" if parts else ""


def network_json(edges: DataFrame) -> DataFrame:
    """Rows as JSON for a sidecar file."""
    return edges.select(F.to_json(F.struct(*edges.columns)).alias("value"))
