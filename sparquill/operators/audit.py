"""Data-quality audit: rules as projections of one scan, one row per issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions import text as X

# What says nothing in a directory's name, and types that need no DOI.
PLAIN_WORDS = ("pmid", "doi", "cell", "nature", "science", "journal", "article", "open", "access")
DOCUMENT_TYPES = ("thesis", "book", "document", "patent", "technical-report", "manual", "lecture-notes", "standard", "white-paper", "presentation", "meeting-notes")
SHORT_TEXT, TITLE_OVERLAP = 200, 0.3
SEVERITY = ("error", "warning", "info")


def _blank(c: str) -> Column:
    return F.trim(X.text_or_empty(c)) == ""


def _title_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("(?U)\\w{4,}"), F.lit(0)))


def rules() -> list[tuple[str, str, Column]]:
    """(severity, rule, condition) over columns dir_name, title, doi, year, n_authors, journal, abstract, paper_type, markdown, corrupt."""
    fine = ~F.col("corrupt")
    md = F.col("markdown")
    h1 = F.regexp_extract(X.text_or_empty(md), "(?m)^#[ \\t]+(\\S.*)$", 1)
    mine, theirs = _title_words(X.text_or_empty("title")), _title_words(h1)
    mismatch = (F.size(mine) > 0) & (F.size(theirs) > 0) & (F.size(F.array_intersect(mine, theirs)) / F.size(mine) < TITLE_OVERLAP)
    name = F.col("dir_name")
    standard = name.rlike("^.+?-\\d{4}-.+$")
    name_year = F.try_to_number(F.nullif(F.regexp_extract(name, "^.+?-(\\d{4})-.+$", 1), F.lit("")), F.lit("9999")).cast("int")
    told = F.filter(F.split(name, "[-_\\s]+"), lambda t: (F.length(t) >= 4) & ~t.rlike("^[0-9]+$") & ~F.lower(t).isin(*PLAIN_WORDS))
    words = F.regexp_extract_all(F.lower(X.text_or_empty("title")), F.lit("[a-z][a-z0-9]{3,}"), F.lit(0))
    only_id = name.rlike("(?i)^PMID-\\d+-(?:Cell|Nature|Science|Journal|Article|Open-Access)$")
    vague = (F.size(told) < 2) & (F.size(words) > 0) & ~F.arrays_overlap(F.transform(told, F.lower), words)
    dup = name.startswith("DUP-")
    return [
        ("error", "invalid_json", F.col("corrupt")),
        ("warning", "missing_doi", fine & _blank("doi") & ~F.coalesce(F.col("paper_type"), F.lit("")).isin(*DOCUMENT_TYPES)),
        ("warning", "missing_abstract", fine & _blank("abstract")),
        ("warning", "missing_year", fine & (F.coalesce(F.col("year"), F.lit(0)) == 0)),
        ("warning", "missing_authors", fine & (F.coalesce(F.col("n_authors"), F.lit(0)) == 0)),
        ("warning", "missing_journal", fine & _blank("journal")),
        ("error", "missing_title", fine & _blank("title")),
        ("error", "missing_md", fine & md.isNull()),
        ("error", "unreadable_md", fine & F.coalesce(F.col("unreadable"), F.lit(False))),
        ("warning", "short_md", fine & md.isNotNull() & (F.length(F.trim(md)) < SHORT_TEXT)),
        ("warning", "title_mismatch", fine & md.isNotNull() & mismatch),
        ("info", "nonstandard_filename", fine & ~standard),
        ("warning", "filename_year_mismatch", fine & standard & (F.coalesce(F.col("year"), F.lit(0)) != 0) & (name_year != F.col("year"))),
        ("warning", "dup_dir_name", fine & dup),
        ("warning", "low_info_dir_name", fine & ~dup & (only_id | vague)),
    ]


def issues(papers: DataFrame) -> DataFrame:
    """(paper_id, severity, rule) of every rule a record breaks, from one scan; then duplicate identifiers.

    A record's issues are an array built beside it, so no rule scans anew.
    """
    for c, kind in (("corrupt", "boolean"), ("unreadable", "boolean"), ("markdown", "string")):
        if c not in papers.columns:
            papers = papers.withColumn(c, F.lit(False if kind == "boolean" else None).cast(kind))
    found = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))) for severity, rule, hit in rules()]))
    each = papers.select(F.col("dir_name").alias("paper_id"), F.explode(found).alias("i")).select("paper_id", "i.severity", "i.rule")
    return each.unionByName(duplicate_keys(papers.where(~F.col("corrupt")), "doi").select("paper_id", F.lit("error").alias("severity"), F.lit("duplicate_doi").alias("rule")))


def duplicate_keys(papers: DataFrame, key: str) -> DataFrame:
    """(paper_id, key, n): records that share a non-empty key with another. Counted first, so that a hot key is no group."""
    keyed = papers.select(F.col("dir_name").alias("paper_id"), F.lower(F.trim(key)).alias(key)).where(F.col(key) != "")
    many = keyed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(many, key)


def in_order(found: DataFrame) -> DataFrame:
    """Errors first, then by paper."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(SEVERITY)], F.lit(9))
    return found.orderBy(rank, "paper_id", "rule")


def report(found: DataFrame) -> str:
    """A text summary, from counts only."""
    rows = found.groupBy("severity", "rule").count().collect()  # a row per rule
    order = {s: i for i, s in enumerate(SEVERITY)}
    lines = [f"{r['severity']}: {r['rule']} {r['count']}" for r in sorted(rows, key=lambda r: (order.get(r["severity"], 9), r["rule"]))]
    return "\n".join(lines) or "no issues"
