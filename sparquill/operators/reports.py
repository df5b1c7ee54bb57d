"""Reports that end on the driver: evidence bundles, planning packages, insights.

Each collects rows whose number is fixed by a budget or a top-k, never a table.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.operators import usage as U
from sparquill.sources import sinks


def bundle_markdown(query: str, bundle: DataFrame, budget: int) -> tuple[str, dict]:
    """(Markdown, checks) of an evidence bundle (paper_id, ordinal, rank, used, content)."""
    rows = bundle.orderBy("rank", "ordinal").collect()  # at most `budget` characters
    parts = [f"# Evidence for: {query}"]
    parts += [f"## {r['paper_id']} · {r['ordinal']}\n\n{r['content']}" for r in rows]
    used = max((r["used"] for r in rows), default=0)
    checks = {"evidence_count": len(rows), "distinct_references": len({r["paper_id"] for r in rows}), "within_budget": used <= budget, "characters": used}
    return "\n\n".join(parts) + "\n", checks


def write_round(spark: SparkSession, folder: str, query: str, bundle: DataFrame, budget: int, at: str) -> int:
    """Write a bundle's Markdown and checks as the next numbered round, and append to the trace; gives the number."""
    text, checks = bundle_markdown(query, bundle, budget)
    trace = f"{folder}/trace"
    number = 1
    if sinks.exists(spark, trace):
        number += spark.read.schema("round int, query string, at string, checks string").json(trace).agg(F.coalesce(F.max("round"), F.lit(0))).first()[0]
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/round-{number:02d}/bundle", lineSep="")
    spark.createDataFrame([(number, query, at, json.dumps(checks))], "round int, query string, at string, checks string").coalesce(1).write.mode("append").json(trace)
    return number


def reference_map(references: DataFrame) -> DataFrame:
    """One row per reference with its citekey; keys that clash get a number by order of id."""
    from pyspark.sql import Window

    from sparquill.operators.exports import cite_key

    keyed = references.withColumn("__k", cite_key())
    n = F.row_number().over(Window.partitionBy("__k").orderBy("id"))
    twice = F.count("*").over(Window.partitionBy("__k")) > 1
    return keyed.withColumn("citekey", F.concat("__k", F.when(twice, F.concat(F.lit("-"), n.cast("string"))).otherwise(""))).drop("__k")


def planning_package(spark: SparkSession, folder: str, references: DataFrame) -> None:
    """Bibliography, reference map and three outlines of a manuscript, written by Spark."""
    from sparquill.operators.exports import bibtex

    mapped = reference_map(references)
    mapped.select(bibtex().alias("value")).write.text(f"{folder}/bibliography", lineSep="\n\n")
    mapped.select("id", "citekey", "title", "year", F.lit("retained").alias("status"), F.lit("may_cite").alias("citation_policy")).write.json(f"{folder}/reference-map")
    outlines = [("outline", "# Outline\n\n## Introduction\n\n## Body\n\n## Conclusion\n"), ("figures", "# Plan\n\n## Figures\n\n| Figure | Title |\n|---|---|\n"), ("claims", "# Claims and evidence\n")]
    spark.createDataFrame(outlines, "name string, value string").write.partitionBy("name").text(f"{folder}/outlines", lineSep="")


def insights(events: DataFrame, texts: DataFrame, titles: DataFrame, text: str, stop: tuple[str, ...], top: int = 10) -> DataFrame:
    """(section, key, n): most frequent words, most read papers, events per week."""
    words = U.keyword_counts(texts, text, stop, top).select(F.lit("keyword").alias("section"), F.col("word").alias("key"), "n")
    reads = U.read_counts(events, titles, top).select(F.lit("read").alias("section"), F.col("title").alias("key"), "n")
    weeks = U.weekly(events).select(F.lit("week").alias("section"), F.col("week").alias("key"), "n")
    return reduce(lambda a, b: a.unionByName(b), [words, reads, weeks])
