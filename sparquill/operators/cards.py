"""Conclusion cards: rendering, and the rule-based ladder that fills them.

A card is struct<takeaway, confidence, mode, key_findings array<struct<claim, basis>>,
quantitative_signals array<struct<text, source>>, limitations array<string>, warnings array<string>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import headings as H

# Document types without a conclusion, budgets of a synthesis, and the ranks of failures.
SKIPPED_TYPES = (
    "thesis", "dissertation", "book", "monograph", "edited-book", "reference-book", "book-chapter", "book-section", "book-part",
    "document", "technical-report", "lecture-notes", "patent",
)
SOURCE_CHARS, SECTION_CHARS = 18_000, 6_000
FAILURES = ("no_text", "no_headings", "no_conclusion", "too_short")
LEAST_CONCLUSION = 80


def _items(col: str, show) -> Column:
    shown = F.transform(F.coalesce(F.col(col), F.array()), show)
    return F.filter(shown, lambda s: s.isNotNull() & (F.trim(s) != ""))


def render(card: str = "card") -> Column:
    """A card as text; a bare explicit section is its takeaway alone, a card without takeaway null."""
    takeaway = F.trim(F.col(f"{card}.takeaway"))
    suffix = lambda text, more, left, right: F.when(F.trim(text) != "", F.concat(F.lit("- "), F.trim(text), F.when(F.coalesce(F.trim(more), F.lit("")) != "", F.concat(F.lit(left), F.trim(more), F.lit(right))).otherwise("")))
    parts = {
        "Key findings:": _items(f"{card}.key_findings", lambda f: suffix(f["claim"], f["basis"], " (", ")")),
        "Quantitative signals:": _items(f"{card}.quantitative_signals", lambda q: suffix(q["text"], q["source"], " [", "]")),
        "Limitations / boundaries:": _items(f"{card}.limitations", lambda t: F.concat(F.lit("- "), F.trim(t))),
        "Warnings:": _items(f"{card}.warnings", lambda t: F.concat(F.lit("- "), F.trim(t))),
    }
    blocks = [F.when(F.size(p) > 0, F.concat(F.lit(f"\n\n{head}\n"), F.array_join(p, "\n"))).otherwise("") for head, p in parts.items()]
    head = F.concat(F.lit("Mode: "), F.coalesce(f"{card}.mode", F.lit("unknown")), F.lit(" | Confidence: "), F.coalesce(f"{card}.confidence", F.lit("unknown")), F.lit("\n\nTakeaway:\n"), takeaway)
    whole = F.concat(head, *blocks)
    bare = (F.coalesce(F.col(f"{card}.mode"), F.lit("")) == "explicit_section") & (F.concat(*blocks) == "")
    return F.when(F.coalesce(takeaway, F.lit("")) == "", F.lit(None)).when(bare, takeaway).otherwise(whole)


def conclusion_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, body) of each document's last section whose heading names a conclusion."""
    lines = H.lines(docs, key, text)
    heads = H.markdown_headings(docs, key, text)
    last = Window.partitionBy(key).orderBy(F.desc("line"))
    chosen = H.section_bounds(heads, key, F.lit(True), F.lit(2**31 - 1)).where(H.is_conclusion(F.col("title"))).withColumn("__n", F.row_number().over(last)).where("__n = 1")
    span = chosen.select(F.col(key).alias("__k"), "title", F.col("line").alias("__from"), F.col("end_line").alias("__to"))
    body = lines.join(span, (lines[key] == span["__k"]) & (F.col("line") > F.col("__from")) & (F.col("line") <= F.col("__to")))
    gathered = body.groupBy(key).agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("line", "s"))).alias("__l"))
    return gathered.select(key, "title", F.trim(F.array_join(F.transform("__l", lambda x: x["s"]), "\n")).alias("body"))


def cards(docs: DataFrame, key: str = "dir_name", text: str = "markdown", paper_type: str = "paper_type") -> DataFrame:
    """(key, card, status, reason): an explicit conclusion by its heading, else why there is none.

    Types without a conclusion are skipped. What a reader would have to judge (validation,
    synthesis over sections) is left to a function over `conclusion_sections` or `synthesis_text`.
    """
    has = docs.select(key, F.col(paper_type).alias("__type"), X.text_or_empty(text).alias("__t"))
    n_heads = H.markdown_headings(docs, key, text).groupBy(key).agg(F.count("*").alias("__heads"))
    found = has.join(n_heads, key, "left").join(conclusion_sections(docs, key, text), key, "left")
    long = F.length("body") >= LEAST_CONCLUSION
    reason = F.when(F.trim("__t") == "", FAILURES[0]).when(F.col("__heads").isNull(), FAILURES[1]).when(F.col("body").isNull(), FAILURES[2]).when(~long, FAILURES[3])
    skipped = F.lower(F.trim(F.coalesce("__type", F.lit("")))).isin(*SKIPPED_TYPES)
    signals = F.transform(X.quantitative_signals("body"), lambda s: F.struct(s.alias("text"), F.col("title").alias("source")))
    card = F.struct(F.col("body").alias("takeaway"), F.lit("high").alias("confidence"), F.lit("explicit_section").alias("mode"), F.array().cast("array<struct<claim:string,basis:string>>").alias("key_findings"), signals.alias("quantitative_signals"), X.limitations("body").alias("limitations"), F.array().cast("array<string>").alias("warnings"))
    return found.select(key, F.when(~skipped & long, card).alias("card"), F.when(skipped, "skipped").when(F.coalesce(long, F.lit(False)), "ok").otherwise("failed").alias("status"), F.when(~skipped, reason).alias("reason"))


def synthesis_text(sections: DataFrame, key: str, order: str, text: str, budget: int = SOURCE_CHARS, each: int = SECTION_CHARS) -> DataFrame:
    """Sections, each compacted, up to a budget of characters; the one that overflows is cut."""
    from sparquill.operators.nodes import cut_to_budget

    return cut_to_budget(sections.withColumn(text, X.head_and_tail(text, each)), [order], text, budget, [key])
