"""Structure of long Markdown: headings, section bounds, running headers, captions, windows, where headings stand."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text as X

# Line windows of the backward scan, and names of sections.
WINDOW_LINES, WINDOW_OVERLAP, SCAN_SHARE, MOST_WINDOWS = 320, 100, 0.40, 6
RUNNING = 3
NOISE = ("contents", "table of contents", "acronyms", "abbreviations", "articleinfo", "affiliations", "目录", "插图目录", "表格目录")
CONCLUSION = "(?i)conclusion|concluding|summary|future directions|future work|outlook|final remarks|closing|结论|总结|结语|小结"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line from 1, s)."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("__at", "s")).select(key, (F.col("__at") + 1).alias("line"), "s")


def markdown_headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, level, title) of # to ###### headings."""
    found = lines(docs, key, text).where(F.col("s").rlike("^#{1,6}\\s+\\S"))
    title = F.trim(F.regexp_replace(F.regexp_replace("s", "^#+\\s+", ""), "\\s+", " "))
    return found.select(key, "line", F.length(F.regexp_extract("s", "^(#+)", 1)).alias("level"), title.alias("title"))


def is_conclusion(title: Column) -> Column:
    return title.rlike(CONCLUSION)


def running_headers(docs: DataFrame, key: str, text: str, least: int = RUNNING) -> DataFrame:
    """(key, title, n) of lines that stand at least `least` times in one document."""
    said = lines(docs, key, text).select(key, F.lower(F.trim("s")).alias("title")).where("title <> ''")
    return said.groupBy(key, "title").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def running_headings(headings: DataFrame, key: str, least: int = RUNNING) -> DataFrame:
    """(key, title, n) of headings, as markdown_headings gives them, that one document repeats at least `least` times."""
    said = headings.select(key, F.lower(F.trim("title")).alias("title"))
    return said.groupBy(key, "title").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def section_bounds(headings: DataFrame, key: str, real: Column, last_line: Column) -> DataFrame:
    """Each heading's section: up to the line before the next real heading, or the document's last."""
    after = Window.partitionBy(key).orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    upcoming = F.min(F.when(real, F.col("line"))).over(after)
    return headings.withColumn("end_line", F.coalesce(upcoming - 1, last_line))


def carry_section(docs: DataFrame, key: str, text: str, default: str = "Document") -> DataFrame:
    """(key, line, section, s): each line under the last second-level heading."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = lines(docs, key, text).withColumn("__h", F.nullif(F.trim(F.regexp_extract("s", "^##\\s+(\\S.*?)\\s*$", 1)), F.lit("")))
    return named.select(key, "line", F.coalesce(F.last("__h", ignorenulls=True).over(w), F.lit(default)).alias("section"), "s")


def backward_windows(docs: DataFrame, key: str, n_lines: Column, size: int = WINDOW_LINES, overlap: int = WINDOW_OVERLAP, share: float = SCAN_SHARE, most: int = MOST_WINDOWS) -> DataFrame:
    """(key, window, start, end): line windows from the end back to `share` of the document, at most `most`."""
    floor = F.greatest(F.lit(1), F.floor(n_lines * share).cast("int"))
    step = size - overlap
    ends = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: n_lines.cast("int") - i * step), lambda e: (e >= floor) & (e > 0))
    # a window whose predecessor already reaches the floor adds nothing
    needed = F.filter(ends, lambda e: (e == n_lines.cast("int")) | (e + step - size + 1 > floor))
    found = docs.select(key, floor.alias("__floor"), F.posexplode(needed).alias("window", "end"))
    return found.select(key, "window", F.greatest(F.col("end") - size + 1, F.col("__floor")).alias("start"), "end")


def captions(docs: DataFrame, key: str, text: str, more: int = 4, most: int = 8) -> DataFrame:
    """(key, line, caption): lines that begin like a figure's or table's, with up to `more` lines that go on."""
    w = Window.partitionBy(key).orderBy("line")
    all_lines = lines(docs, key, text)
    stop = F.lit(False)
    caption = F.trim("s")
    for i in range(1, more + 1):
        nxt = F.trim(F.coalesce(F.lead("s", i).over(w), F.lit("")))
        stop = stop | (nxt == "") | nxt.startswith("#") | nxt.rlike("^(?i:fig(?:ure)?\\.?|table)\\s*\\d|^[图表]\\s*\\d")
        caption = F.concat(caption, F.when(stop, "").otherwise(F.concat(F.lit(" "), nxt)))
    found = all_lines.withColumn("caption", caption).where(F.trim("s").rlike("^(?i:fig(?:ure)?\\.?|table)\\s*\\d|^[图表]\\s*\\d"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    return found.withColumn("__n", n).where(F.col("__n") <= most).select(key, "line", "caption")


# --- where headings stand in a text

#: Candidates of one document that are looked for at once; more are dealt to several passes over it.
AT_ONCE = 2000
#: A line of fewer characters, or of less than half of a candidate, is only taken where they are equal.
SHORTEST = 8


def folded_heading(text: str) -> str:
    """Case folded, each run of anything but letters, digits and underscores one blank."""
    return re.sub(r"\s+", " ", re.sub(r"[^\w\u4e00-\u9fff]+", " ", text.casefold().replace("．", "."))).strip()


def _automaton(words: dict[str, int]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for w, value in words.items():
        found.add_word(w, (w, value))
    found.make_automaton()
    return found


def places(candidates: list[str], text: str) -> list[int | None]:
    """The line, from 1, of each candidate: the first that equals it, else the first that holds it or that it holds.

    One pass over the text finds the candidates in lines, one over the candidates finds lines in them.
    """
    folded = [folded_heading(c) for c in candidates]
    asked = {c: 0 for c in folded if c}
    first: dict[str, int] = {}
    for n, line in enumerate(text.split("\n"), 1):
        first.setdefault(folded_heading(line), n)
    near: dict[str, int] = {}
    long = {line: n for line, n in first.items() if len(line) >= SHORTEST}
    if asked and long:
        within = _automaton(asked)
        for line, n in long.items():
            for _, (c, _) in within.iter(line):
                near[c] = min(near.get(c, n), n)
        around = _automaton(long)
        for c in asked:
            for _, (line, n) in around.iter(c):
                if len(line) >= len(c) // 2:
                    near[c] = min(near.get(c, n), n)
    return [first.get(c, near.get(c)) if c else None for c in folded]


def locate(docs: DataFrame, candidates: DataFrame, key: str = "doc_id", text: str = "text", candidate: str = "candidate") -> DataFrame:
    """candidates (key, candidate), distinct, that stand in their document's text: (key, candidate, line).

    A document's candidates meet its text once, by key; where there are more than AT_ONCE they are
    dealt to as many rows. Documents without text or candidates, and null keys, give nothing.
    """
    asked = candidates.select(key, F.col(candidate).alias("candidate")).where(F.col("candidate").isNotNull()).distinct()
    parts = asked.groupBy(key).agg(F.ceil(F.count("*") / F.lit(float(AT_ONCE))).alias("parts"))
    dealt = asked.join(parts, key).withColumn("part", F.pmod(F.xxhash64("candidate"), F.col("parts")))
    met = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text")).join(dealt.groupBy(key, "part").agg(F.collect_list("candidate").alias("asked")), key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, c, n) for k, t, asked in zip(b[key], b["text"], b["asked"], strict=True) for c, n in zip(asked, places(list(asked), t), strict=True) if n is not None]
            yield pd.DataFrame(rows, columns=[key, "candidate", "line"])

    return met.select(key, "text", "asked").mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, candidate string, line int")
