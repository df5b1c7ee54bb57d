"""Evidence nodes: order, neighbours, budgets, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes of a chunk in the index, and of an evidence bundle.
CHUNK_CHARS, CHUNK_OVERLAP = 1200, 120
BUNDLE_CHARS, NODE_CHARS, NEIGHBOURS = 40_000, 6_000, 1


def node_id(paper: Column, ordinal: Column) -> Column:
    return F.concat_ws(":", paper.cast("string"), F.lpad(ordinal.cast("string"), 4, "0"))


def linked(nodes: DataFrame) -> DataFrame:
    """(paper_id, ordinal, ...) with node_id, prev_id and next_id."""
    w = Window.partitionBy("paper_id").orderBy("ordinal")
    named = nodes.withColumn("node_id", node_id(F.col("paper_id"), F.col("ordinal")))
    return named.withColumns({"prev_id": F.lag("node_id").over(w), "next_id": F.lead("node_id").over(w)})


def by_ids(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes of a list (node_id, pos), in the list's order; ids that no node has give nothing."""
    return nodes.join(wanted.select("node_id", "pos"), "node_id").orderBy("pos")


def with_neighbours(nodes: DataFrame, hits: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Nodes within k places of a hit (paper_id, ordinal, rank), once each, in order of the hit that brings them.

    Hits are spread over their 2k+1 places first, so the join is on equal keys.
    """
    places = hits.select("paper_id", "rank", F.explode(F.sequence(F.col("ordinal") - k, F.col("ordinal") + k)).alias("ordinal"))
    first = places.groupBy("paper_id", "ordinal").agg(F.min("rank").alias("rank"))
    return nodes.join(first, ["paper_id", "ordinal"]).orderBy("rank", "ordinal")


def within_budget(blocks: DataFrame, order: list[str], length: Column, budget: int, by: list[str] | None = None) -> DataFrame:
    """The leading blocks whose lengths sum to at most the budget, per group."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("used", F.sum(length).over(w)).where(F.col("used") <= budget)


def cut_to_budget(blocks: DataFrame, order: list[str], text: str, budget: int, by: list[str] | None = None) -> DataFrame:
    """As within_budget, but the block that overflows is cut, not dropped."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    return blocks.withColumn("__left", F.lit(budget) - before).where("__left > 0").withColumn(text, F.expr(f"substring({text}, 1, cast(__left as int))")).drop("__left")


def bundle(nodes: DataFrame, hits: DataFrame, k: int = NEIGHBOURS, budget: int = BUNDLE_CHARS, per_node: int = NODE_CHARS) -> DataFrame:
    """Evidence around hits under a budget of characters; hits are at most a page, so one window orders them."""
    found = with_neighbours(nodes, hits, k).withColumn("content", F.substring("content", 1, per_node))
    return within_budget(found, ["rank", "ordinal"], F.length("content"), budget)


# --- chunks


def _collapse(text: str) -> str:
    return " ".join(text.split())


def _boundary(text: str, at: int, floor: int) -> int:
    """The nearest place at or before `at`, not below floor, that follows white space; floor if none."""
    cut = at
    while cut > floor and not text[cut - 1].isspace():
        cut -= 1
    return cut


def slices(text: str, size: int, overlap: int) -> list[str]:
    """Overlapping pieces cut at white space; a piece without any is cut at its full size.

    Every piece begins after the last one did: where a piece is no longer than the
    overlap, the next begins at its end.
    """
    found, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            soft = _boundary(text, end, start + max(size // 2, 1))
            if text[soft - 1].isspace():
                end = soft
        piece = text[start:end].strip()
        if piece:
            found.append(piece)
        if end == len(text):
            break
        back = end - overlap
        if back <= start:
            start = end
            continue
        soft = _boundary(text, back, start + 1)
        start = soft if text[soft - 1].isspace() else back
    return found


def sections(markdown: str) -> list[tuple[str, str]]:
    """(title, body) by second-level headings; what stands ahead of them is `Document`, a leading title line goes."""
    lines = markdown.replace("\r\n", "\n").replace("\r", "\n").strip().split("\n")
    if lines and re.match(r"#\s", lines[0]):
        lines = lines[1:]
    found: list[tuple[str, list[str]]] = [("Document", [])]
    for line in lines:
        m = re.match(r"##\s+(\S.*?)\s*$", line)
        if m:
            found.append((_collapse(m[1]), []))
        else:
            found[-1][1].append(line.rstrip())
    return [(title, body) for title, part in found if (body := "\n".join(part).strip())]


def chunk_body(body: str, size: int, overlap: int) -> list[str]:
    """Paragraphs gathered up to size; a new chunk starts with the end of the last one."""
    found, held = [], ""
    for paragraph in filter(None, map(_collapse, re.split(r"\n\s*\n", body))):
        if len(paragraph) > size:
            found += ([held] if held else []) + slices(paragraph, size, overlap)
            held = ""
        elif not held:
            held = paragraph
        elif len(held) + 2 + len(paragraph) <= size:
            held = f"{held}\n\n{paragraph}"
        else:
            found.append(held)
            tail = held if len(held) <= overlap else held[_boundary(held, len(held) - overlap, 0) :]
            held = f"{tail.strip()}\n\n{paragraph}" if overlap and tail.strip() else paragraph
            if len(held) > size:
                found += slices(held, size, overlap)
                held = ""
    return [*found, held] if held else found


def chunk_markdown(markdown: str, title: str = "", size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> list[tuple[str, str]]:
    """(section, content) of each chunk; content starts with title and section."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the size")
    name = title.strip()
    if not name:
        m = re.search(r"^#\s+(\S.*?)\s*$", markdown, re.MULTILINE)
        name = _collapse(m[1]) if m else "Untitled"
    return [(section, f"Title: {name}\nSection: {section}\n{part}") for section, body in sections(markdown) for part in chunk_body(body, size, overlap)]


def chunks(texts: DataFrame, key: str = "paper_id", markdown: str = "markdown", title: str | None = None, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(paper_id, ordinal, section, content) of every text: stateful scanning, so batches of rows in Python."""
    rows = texts.select(F.col(key).alias("paper_id"), F.coalesce(F.col(markdown), F.lit("")).alias("m"), (F.coalesce(F.col(title), F.lit("")) if title else F.lit("")).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(p, i, s, c) for p, m, t in zip(b["paper_id"], b["m"], b["t"], strict=True) for i, (s, c) in enumerate(chunk_markdown(m, t, size, overlap), 1)]
            yield pd.DataFrame(found, columns=["paper_id", "ordinal", "section", "content"])

    kind = dict(rows.dtypes)["paper_id"]
    return rows.mapInPandas(run, f"paper_id {kind}, ordinal int, section string, content string")
