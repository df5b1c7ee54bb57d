"""Usage analytics over an append-only event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text as X


def select_events(events: DataFrame, category: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; the conditions are plain comparisons, so they reach the Parquet scan."""
    for value, make in ((category, lambda v: F.col("event_type") == v), (since, lambda v: F.col("ts") >= F.lit(v).cast("timestamp_ntz")), (until, lambda v: F.col("ts") <= F.lit(v).cast("timestamp_ntz"))):
        if value is not None:
            events = events.where(make(value))
    ordered = events.orderBy(F.desc("event_id"))
    return ordered if limit is None else ordered.limit(limit)


def summary(events: DataFrame, value: str = "value") -> DataFrame:
    """One row: calls and rounded sums, zero over no rows."""
    return events.agg(F.count("*").alias("n_calls"), F.bround(F.coalesce(F.sum(value), F.lit(0.0)), 2).alias("total_value"), F.countDistinct("user_id").alias("n_users"))


def keyword_counts(texts: DataFrame, column: str, stop: tuple[str, ...], top: int, least: int = 2) -> DataFrame:
    """Words split at white space, lower-cased, outer punctuation off; the most frequent, ties by word."""
    word = F.regexp_replace(F.lower(F.col("w")), "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")
    words = texts.select(F.explode(F.split(X.text_or_empty(column), "\\s+")).alias("w")).select(word.alias("word"))
    kept = words.where((F.length("word") >= least) & ~F.col("word").isin(*stop))
    return kept.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def weekly(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.groupBy(X.week_key(ts).alias("week")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


def within_last(events: DataFrame, seconds: int, by: list[str], ts: str = "ts") -> DataFrame:
    """Each event with the number of the group's events in the seconds up to it."""
    w = Window.partitionBy(*by).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return events.withColumn("in_window", F.count("*").over(w))


def sessions(events: DataFrame, gap_seconds: int, by: str = "user_id", ts: str = "ts") -> DataFrame:
    """One row per session: events no more than the gap apart."""
    w = Window.partitionBy(by).orderBy(ts, "event_id")
    at = F.col(ts).cast("timestamp").cast("long")
    started = events.withColumn("__new", F.coalesce((at - F.lag(at).over(w) > gap_seconds).cast("int"), F.lit(1)))
    numbered = started.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(by, "session").agg(F.count("*").alias("n_events"), F.min(ts).alias("started"), F.max(ts).alias("ended"))


def read_counts(events: DataFrame, titles: DataFrame, top: int) -> DataFrame:
    """Reads per paper (`name`), the counts re-keyed by resolved title; names without record keep their own."""
    reads = events.groupBy("name").agg(F.count("*").alias("n"))
    titled = reads.join(titles.select("name", "title"), "name", "left").withColumn("title", F.coalesce("title", F.col("name").cast("string")))
    return titled.groupBy("title").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "title").limit(top)


def neighbours_unread(candidates: DataFrame, read: DataFrame, top: int) -> DataFrame:
    """Best score of each candidate over several searches, without what was read."""
    fresh = candidates.join(read.select("paper_id").distinct(), "paper_id", "left_anti")
    return fresh.groupBy("paper_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "paper_id").limit(top)


def detail(path: str, column: str = "props") -> Column:
    return F.get_json_object(column, path)
