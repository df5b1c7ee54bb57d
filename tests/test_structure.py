"""Merged headings, where a body starts, and tables of contents, against rules written line by line."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sparquill.operators import structure as S

PREFIXES = ("", "", "1 ", "1. ", "2.3 ", "4.5.6.7 ", "1．2 ", "3Method", "Chapter 4 ", "chapter 12", "第三章", "IV. ", "mix ", "B) ", "Appendix A ")
TAILS = ("Introduction", "RESULTS", "results and discussion", "Conclusions:", "some words that say little", "DOI of it", "see https://x.org", "A, b; c: d! e?", "ALL IN CAPITALS (2)", "a@b", "Results, in short", "结 论", "word " * 30, "One. Two. " + "x" * 90, "Wetlands ... 23", "")
ANY_PREFIX = (r"(?i)Chapter\s+(\d+)\b", r"第\s*([一二三四五六七八九十百\d]+)\s*章", r"(\d+(?:[.．]\d+)*)[.．]?\s*", r"(?i)([IVXLCDM]+)[\s.)]+", r"([A-Z])[\s.)]+")


def tidy(s: str) -> str:
    return " ".join(s.strip().lstrip("#").split()).strip(" :：")


def tail_of(s: str) -> str:
    hit = next((m for m in (re.match(p, s) for p in ANY_PREFIX) if m), None)
    return s[hit.end() :].strip() if hit else s


def known(s: str) -> bool:
    bare = tidy(tail_of(s))
    low = bare.lower().partition(",")[0].strip().rstrip(":：")
    return low in S.SECTIONS or low.startswith(("appendix", "supplementary")) or bare.replace(" ", "").startswith(S.SECTIONS_ZH)


def plain(s: str) -> bool:
    if not s or len(s) > 160 or len(s.split()) > 24 or "@" in s or "://" in s or re.search(r"\b(doi|copyright|received|accepted|published)\b", s.lower()):
        return False
    if sum(s.count(c) for c in ",;:!?。") > 3:
        return False
    number = re.match(S.NUMBERED.replace("\\\\", "\\"), s)
    if number or any(re.match(p, s) for p in (ANY_PREFIX[0], ANY_PREFIX[1], ANY_PREFIX[3], ANY_PREFIX[4])):
        return tail_of(s) != "" and not (len(s) > 90 and sum(tail_of(s).count(c) for c in ".!?;") > 1)
    return known(s) or (re.fullmatch(r"[A-Z][A-Z0-9\s/&()\-]{2,80}", s) is not None and len(s.split()) <= 12)


def test_plain_lines_equal_the_rules(spark):
    r = random.Random(3)
    lines = sorted({(p + t + e) for p in PREFIXES for t in TAILS for e in ("", "  ", " :")})
    r.shuffle(lines)
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "d int, t string")
    got = {(x.line, x.title) for x in S.plain_headings(docs, "d", "t").collect()}
    want = {(n, tidy(s)) for n, s in enumerate(lines, 1) if s.strip() and plain(tidy(s))}
    assert got == want and 100 < len(want) < len(lines)


def test_sources_are_merged_by_line_with_markdown_first(spark):
    text = "# Title\nINTRODUCTION\n## 2 Methods\nthe text goes on here\nObscure words here\n2.1 Sampling\n## 2 METHODS:"
    docs = spark.createDataFrame([("a", text)], "d string, t string")
    layout = spark.createDataFrame([("a", "Methods of 2", 1), ("a", "2 methods", 1), ("a", "Obscure words here", 2), ("a", "the text goes on here", None), ("a", "2.1 Sampling", 3)], "d string, text string, level long")
    got = sorted((x.line, x.level, x.title, x.source) for x in S.merged_headings(docs, "d", "t", layout).collect())
    assert got == [(1, 1, "Title", "markdown"), (2, 1, "INTRODUCTION", "plaintext"), (3, 2, "2 Methods", "markdown"), (5, 2, "Obscure words here", "layout"), (6, 2, "2.1 Sampling", "plaintext"), (7, 2, "2 METHODS", "markdown")]


@pytest.mark.parametrize(("titles", "want"), [
    (["Contents", "1 A ... 10", "2 B ... 12", "3 C 14", "4 D 16", "5 E 18", "Odd", "Chapter 1 A", "2 B"], ["Chapter 1 A", "2 B"]),
    (["1 A ... 10", "2 B ... 12", "3 C 14", "4 D 16", "Odd"], ["1 A ... 10", "2 B ... 12", "3 C 14", "4 D 16", "Odd"]),
    (["1 A ... 10", "2 B ... 12", "3 C 14", "4 D 16", "5 E 18"], ["1 A ... 10", "2 B ... 12", "3 C 14", "4 D 16", "5 E 18"]),
    (["Odd", "Symbols to know", "2 B"], ["Symbols to know", "2 B"]),
    (["Odd", "Even"], ["Odd", "Even"]),
])
def test_where_the_body_starts(spark, titles, want):
    rows = spark.createDataFrame([(1, n, 1, t) for n, t in enumerate(titles, 1)] + [(2, 1, 1, "Odd"), (2, 2, 1, "1 X")], "d int, line int, level int, title string")
    assert [r.title for r in S.body(rows, "d").where("d = 1").orderBy("line").collect()] == want
    assert [r.title for r in S.body(rows, "d").where("d = 2").collect()] == ["1 X"]


def test_headings_repeated_before_the_body_do_not_count(spark):
    titles = ["Results 10", "Results 20", "Methods 30", "Results", "Results", "1 Start", "Results", "Chapter 2", "第三章 x", "1.2.3.4 Deep 12", "Run", "Conclusion", "The Paper"]
    rows = spark.createDataFrame([(1, n, 1, t) for n, t in enumerate(titles, 1)], "d int, line int, level int, title string")
    got = [(r.level, r.title) for r in S.toc(rows, "d", F.lit("the paper")).orderBy("line").collect()]
    assert got == [(1, "1 Start"), (1, "Results"), (1, "Chapter 2"), (1, "第三章 x"), (3, "1.2.3.4 Deep"), (1, "Conclusion")]
    assert S.toc(rows.limit(0), "d").count() == 0


def test_the_rule_toc_lists_markdown_headings_only(spark, tmp_path):
    """Numbered plain lines of a text are no headings to its SQL."""
    from compare import compare

    from sparquill.plans.corpus_queries import rule_toc
    from sparquill.plans.registry import ORACLE

    texts = ["1219538112535716 Éaielletre\nRESULTS", "## 3.1 Named\nplain", "4. Methods"]
    spark.createDataFrame([(i, t, "en", "src") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"file://{tmp_path}/made")
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    assert compare(rule_toc(spark, f"{tmp_path}"), ORACLE["rule_toc"], str(tmp_path)) == []
