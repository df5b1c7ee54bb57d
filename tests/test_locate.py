"""Lines of headings against a plain search."""

from __future__ import annotations

import time

from hypothesis import given, settings
from hypothesis import strategies as st

from sparquill.operators import headings as H
from sparquill.plans import more_queries


def _plain(candidate, text):
    c = H.folded_heading(candidate)
    if not c:
        return None
    lines = [H.folded_heading(s) for s in text.split("\n")]
    for n, s in enumerate(lines, 1):
        if s == c:
            return n
    for n, s in enumerate(lines, 1):
        if (c in s or s in c) and len(s) >= max(8, len(c) // 2):
            return n
    return None


parts = st.lists(st.sampled_from(["Methods", "and", "results", "1.", "２．", "ÜBER", "über", "结论", " ", "\t", "-", "\n", "\n\n", "a", "materials"]), max_size=14).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(parts, max_size=6), parts)
def test_places_equal_a_plain_search(candidates, text):
    assert H.places(candidates, text) == [_plain(c, text) for c in candidates]


def test_located_headings(spark, monkeypatch):
    text = "# Intro\nMaterials and methods of the study\n\nResults\nmethods of the\nIntro"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "alone"), (None, "Results")], "doc_id long, text string")
    asked = [(1, c) for c in ("intro", "Materials  and METHODS", "results", "nothing", "", "the methods of the study and more", None, "intro")] + [(2, "x"), (3, "x"), (9, "x"), (None, "Results")]
    want = {(1, c, n) for c in dict(asked[:8][::-1]).values() or [] if c and (n := _plain(c, text))} | {(1, c, _plain(c, text)) for _, c in asked[:8] if c and _plain(c, text)}
    for most in (2000, 2):
        monkeypatch.setattr(H, "AT_ONCE", most)
        got = [tuple(r) for r in H.locate(docs, spark.createDataFrame(asked, "doc_id long, candidate string")).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert H.locate(docs.where("false"), spark.createDataFrame(asked, "doc_id long, candidate string")).count() == 0


def test_many_headings_in_a_long_text():
    lines = [f"line {i} of a long text about things" for i in range(30_000)]
    began = time.time()
    got = H.places([f"Line {i} of a long text" for i in range(0, 30_000, 10)] + ["no such heading here"], "\n".join(lines))
    assert got[:3] == [1, 11, 21] and got[-1] is None and time.time() - began < 20


def test_heading_lines_of_pages(spark, sf_dir):
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    want = set()
    for p in pages:
        text = re.sub(r"<[^>]*>", "\n", p.html or "")
        want |= {(p.page_id, c, n) for c in re.findall(r"(?i)<(?:title|h[1-6])[^>]*>([^<]+)</", p.html or "") if (n := _plain(c, text))}
    got = [tuple(r) for r in more_queries.heading_lines(spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= len(pages) / 2
