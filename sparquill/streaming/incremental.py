"""Incremental maintenance and event streams with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparquill.functions import text as X
from sparquill.session import stored
from sparquill.sources import sinks


def index_stream(source: DataFrame, table: str, checkpoint: str, key: str = "paper_id", buckets: int = sinks.BUCKETS) -> StreamingQuery:
    """Upsert a stream of records (key, content) into a table in buckets: unchanged digests are skipped; runs until the input ends.

    A batch rewrites only the buckets it changes; one that is replayed changes nothing, as its
    digests are already there.
    """

    def apply(batch: DataFrame, number: int) -> None:
        sinks.upsert_buckets(batch.withColumn("content_hash", X.short_hash("content")), table, key, batch=number, buckets=buckets)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_stream(source: DataFrame, index: str, checkpoint: str) -> StreamingQuery:
    """Keep a stored inverted index (operators.inverted) up with a stream of nodes (node_id, content)."""
    from sparquill.operators import inverted

    def apply(batch: DataFrame, number: int) -> None:
        inverted.update(batch, index, number)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(source: DataFrame, existing: DataFrame, accepted: str, pending: str, checkpoint: str, buckets: int = sinks.BUCKETS) -> StreamingQuery:
    """Decide on each batch of incoming records against the library and what earlier batches accepted.

    Decisions equal `identity.ingest_decision` over all records at once, however they are parted
    into batches in order of pos. The identifiers of the library (read once, when the stream first
    starts) and of accepted records lie beside the checkpoint in folders by batch and hash; a batch
    reads the folders of its own identifiers, not the accepted table. Whether a record holds an
    identifier hangs on its others, so state keyed by identifier cannot settle it. A batch that is
    run again sees earlier batches alone and replaces what it wrote.
    """
    from sparquill.operators import identity as I

    held = f"{checkpoint}/identifiers"
    bucket = F.pmod(F.xxhash64("kind", "value"), F.lit(buckets)).cast("int").alias("bucket")

    def hold(rows: DataFrame, of: str, earlier: bool, folder: int) -> None:
        found = I.identifiers(rows, of).select("kind", "value", F.col(of).cast("string").alias("id"), F.lit(earlier).alias("earlier"), bucket)
        found.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{held}/batch={folder}")

    if not sinks.exists(existing.sparkSession, f"{held}/batch=0/_SUCCESS"):
        hold(existing, "id", False, 0)

    def apply(batch: DataFrame, number: int) -> None:
        rows = stored(batch, "ingest-batch")
        near = [r[0] for r in I.identifiers(rows).select(bucket).distinct().collect()]  # at most `buckets` numbers
        known = rows.sparkSession.read.schema("kind string, value string, id string, earlier boolean, batch long, bucket int").parquet(held)
        known = known.where((F.col("batch") <= number) & F.col("bucket").isin(near))
        decided = stored(I.ingest_among(rows, known), "ingest-decided")
        sinks.split_pending(decided, accepted, pending, number)
        hold(decided.where("status = 'ingested'"), "pos", True, number + 1)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def silo_stream(source: DataFrame, table: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Append records whose key the silo lacks."""

    def apply(batch: DataFrame, _: int) -> None:
        sinks.append_new(batch, table, keys)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Counts per window and type; timestamps without zone are read as UTC, since watermarks need one."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "user_id", "n")


def deduplicated(source: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first of each key within the watermark."""
    return source.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into an in-memory table, for tests and small reports."""
    spark: SparkSession = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
