"""Corpus subsets: screening, scope, coverage, status, set maintenance."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text as X

# Defaults of the screening and scope word lists.
SCREEN_STOP = ("and", "the", "for", "with", "review", "paper", "study")
SCOPE_STOP = ("with", "from", "into", "this", "that", "review", "paper", "cancer", "tumor")
OFF_SCOPE = ("prostate", "glioblastoma", "pancreatic", "colorectal", "renal", "leber", "microneedle", "bacteria")
RECENT = 2020


def screen_terms(criteria: str, stop: tuple[str, ...] = SCREEN_STOP) -> list[str]:
    return sorted({t for t in re.findall(r"[A-Za-z0-9]+", criteria.lower()) if len(t) >= 3 and t not in stop})


def screen_score(criteria: str, title: Column, body: Column, has_l3: Column, full_text: Column, year: Column, off_scope: tuple[str, ...] = OFF_SCOPE) -> Column:
    """5 a matched word, 2 for a card, 3 for full text, 1 for a review, 1 for a recent year, -20 an off-scope word in the title."""
    low, name = F.lower(X.text_or_empty(body)), F.lower(X.text_or_empty(title))
    count = lambda words, where: reduce(lambda a, b: a + b, [F.when(F.contains(where, F.lit(w)), 1).otherwise(0) for w in words], F.lit(0))
    flag = lambda c, points: F.when(F.coalesce(c, F.lit(False)), points).otherwise(0)
    return (count(screen_terms(criteria), low) * 5 + flag(has_l3, 2) + flag(full_text, 3) + flag(F.contains(name, F.lit("review")), 1) + flag(year >= RECENT, 1) - count(off_scope, name) * 20).cast("long")


def screen(scored: DataFrame, target: int | None, tie: str) -> DataFrame:
    """Rows with `retained`: the best `target` by (score, year), ties by `tie`.

    The cut is found by a top-k over narrow rows; nothing is sorted whole.
    """
    if target is None:
        return scored.withColumn("retained", F.lit(True))
    order = [F.desc("score"), F.desc(F.coalesce("year", F.lit(0))), F.asc(tie)]
    best = scored.orderBy(*order).limit(target).select(tie, F.lit(True).alias("retained"))
    return scored.join(best, tie, "left").withColumn("retained", F.coalesce("retained", F.lit(False)))


def scope_decision(scope: str, text: Column, stop: tuple[str, ...] = SCOPE_STOP) -> Column:
    """struct(decision, overlap): two shared words are in scope, none is out, one is uncertain."""
    words = sorted({t for t in re.findall(r"[A-Za-z0-9]+", scope.lower()) if len(t) >= 4 and t not in stop})
    if not scope.strip():
        return F.struct(F.lit("uncertain").alias("decision"), F.array().cast("array<string>").alias("overlap"))
    mine = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    has = F.array_intersect(mine, F.regexp_extract_all(F.lower(X.text_or_empty(text)), F.lit("[a-z0-9]+"), F.lit(0)))
    decision = F.when(F.size(has) >= 2, "in_scope").when(F.size(has) == 0, "out_of_scope").otherwise("uncertain")
    return F.struct(decision.alias("decision"), F.array_sort(has).alias("overlap"))


def entries_dedup(entries: DataFrame) -> DataFrame:
    """Entries of a workspace by id: rows without id and marked duplicates go, the first of the rest stays."""
    kept = entries.where(F.col("id").isNotNull() & (F.trim("id") != "") & ~F.coalesce(F.col("dir_name").startswith("DUP-"), F.lit(False)))
    w = Window.partitionBy("ws", "id").orderBy("pos")
    return kept.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def add_entries(entries: DataFrame, new: DataFrame) -> DataFrame:
    """New entries that the workspace doesn't hold yet, after those it does."""
    fresh = entries_dedup(new).join(entries, ["ws", "id"], "left_anti")
    end = entries.groupBy("ws").agg(F.max("pos").alias("end"))
    placed = fresh.join(end, "ws", "left").withColumn("pos", F.coalesce("end", F.lit(-1)) + 1 + F.row_number().over(Window.partitionBy("ws").orderBy("pos")) - 1).drop("end")
    return entries.unionByName(placed)


def remove_entries(entries: DataFrame, gone: DataFrame) -> DataFrame:
    return entries.join(gone.select("ws", "id").distinct(), ["ws", "id"], "left_anti")


def evidence(entries: DataFrame, registry: DataFrame, papers: DataFrame, fulltext: DataFrame) -> DataFrame:
    """Entries in order with the registry's current name, the record and its full-text status; entries without record go."""
    current = registry.select("id", F.col("dir_name").alias("__now"))
    named = entries.join(current, "id", "left").withColumn("dir_name", F.coalesce("__now", "dir_name")).drop("__now")
    text = fulltext.select("dir_name", F.lit("full_text").alias("full_text_status")).distinct()
    found = named.join(papers.drop("id"), "dir_name").join(text, "dir_name", "left")
    return found.withColumn("full_text_status", F.coalesce("full_text_status", F.lit("metadata_only")))


def status(rows: DataFrame) -> DataFrame:
    """Histograms in one pass: (dimension, value, n, with_l3, with_text) by type, by year and over all."""
    kind = F.coalesce(F.nullif(F.trim("paper_type"), F.lit("")), F.lit("unknown"))
    year = F.coalesce(F.col("year").cast("string"), F.lit("unknown"))
    narrow = rows.select(kind.alias("paper_type"), year.alias("year"), F.col("has_l3").cast("long").alias("l"), F.col("has_text").cast("long").alias("t"))
    narrow.createOrReplaceTempView("sparquill_status_rows")
    return rows.sparkSession.sql("""
        SELECT CASE grouping_id(paper_type, year) WHEN 1 THEN 'paper_type' WHEN 2 THEN 'year' ELSE 'all' END AS dimension,
               coalesce(paper_type, year, 'all') AS value, count(*) AS n, sum(l) AS with_l3, sum(t) AS with_text
        FROM sparquill_status_rows GROUP BY GROUPING SETS ((paper_type), (year), ())
    """)


def coverage_by(references: DataFrame, dimensions: list[str], cited: str = "cited") -> DataFrame:
    """(dimension, value, total, cited) over independent dimensions: one scan, grouping sets."""
    kept = references.select(*[F.coalesce(F.col(d), F.lit("unknown")).alias(d) for d in dimensions], F.col(cited).cast("long").alias("c"))
    sets = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return kept.select(F.explode(sets).alias("s"), "c").groupBy("s.dimension", "s.value").agg(F.count("*").alias("total"), F.sum("c").alias("cited"))


# What a reference's status, policy and validity must be to be required.
def required(status: Column, policy: Column, valid: Column) -> Column:
    """Whether a retained, citable reference must be cited."""
    return (status == "retained") & (policy == "must_cite") & valid


def citation_coverage(references: DataFrame, manuscripts: DataFrame, key: str = "citekey") -> DataFrame:
    """(citekey, cited, required, known): keys of the map and of the manuscripts, outer-joined."""
    used = manuscripts.select(F.explode(X.citekeys("text")).alias(key)).distinct().withColumn("cited", F.lit(True))
    have = references.select(key, "required").withColumn("known", F.lit(True))
    both = have.join(used, key, "full")
    return both.select(key, F.coalesce("cited", F.lit(False)).alias("cited"), F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("known", F.lit(False)).alias("known"))


def figure_status(planned: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Planned figures with their manifest entry and whether the file is there."""
    there = files.select("path", F.lit(True).alias("__there")).distinct()
    found = planned.join(manifest, "figure", "left").join(there, "path", "left")
    return found.withColumn("status", F.when(F.col("__there"), "complete").when(F.col("path").isNotNull(), "file_missing").otherwise("missing")).drop("__there")


def planned_figures(plans: DataFrame, key: str = "ws", text: str = "text") -> DataFrame:
    """(ws, figure, row): rows of the table under `## Figures` whose first cell starts with F."""
    lines = plans.select(key, F.posexplode(F.split(text, "\n")).alias("line", "s"))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.last(F.when(F.col("s").rlike("^#{1,6}\\s"), F.lower(F.trim(F.regexp_replace("s", "^#+", "")))), ignorenulls=True).over(w)
    cells = F.transform(F.split(F.regexp_replace(F.trim("s"), "^\\||\\|$", ""), "\\|"), lambda x: F.trim(x))
    rows = lines.withColumn("__at", at).where((F.col("__at") == "figures") & F.trim("s").startswith("|")).withColumn("__cells", cells)
    return rows.where(F.element_at("__cells", 1).rlike("^F")).select(key, F.element_at("__cells", 1).alias("figure"), F.col("__cells").alias("row"))


def validate_name(name: str) -> str:
    """A name for a subset or silo; ValueError if it could leave its folder."""
    if not name or name != name.strip() or name in (".", "..") or re.search(r"[/\\:\0]|^\.|\s{2,}", name):
        raise ValueError(f"not a usable name: {name!r}")
    return name
