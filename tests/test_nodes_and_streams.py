"""Chunks, windows, headings; sinks and streams."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparquill.operators import headings as H
from sparquill.operators import structure as S
from sparquill.operators import nodes as N
from sparquill.sources import sinks
from sparquill.streaming import incremental as inc


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(10, 60), st.integers(0, 9))
def test_slices_cover_and_progress(words, size, overlap):
    letters = map(chr, range(0x4E00, 0x9000))  # each once, so that a piece's place is known
    text = " ".join("".join(next(letters) for _ in range(n)) for n in words)
    found = N.slices(text, size, overlap)
    assert all(0 < len(p) <= size for p in found)
    at = 0
    for p in found:
        i = text.find(p)
        assert i >= 0 and not text[at:i].strip()
        at = max(at, i + len(p))
    assert not text[at:].strip()


def test_text_without_space_makes_full_pieces():
    assert len(N.slices("x" * 3000, 1200, 120)) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab ", min_size=1, max_size=90), max_size=8))
def test_chunks_are_bounded(paragraphs):
    for section, content in N.chunk_markdown("# T\n\n" + "\n\n".join(paragraphs), size=60, overlap=10):
        assert section == "Document" and content.startswith("Title: T\nSection: Document\n")
        assert len(content) <= 60 + len("Title: T\nSection: Document\n")


def test_slices_end_where_pieces_are_shorter_than_the_overlap():
    letters = iter(range(0x4E00, 0x5000))  # no letter twice, so that a piece has one place
    text = " ".join("".join(chr(next(letters)) for _ in range(n)) for n in (2, 1, 5, 16, 3, 40, 1))
    for size in range(1, 40):
        for overlap in range(size):
            found = N.slices(text, size, overlap)
            assert all(len(p) <= size for p in found) and len(found) <= len(text)
            at = 0
            for p in found:  # in order, nothing left out but white space
                assert not text[at : text.index(p)].strip()
                at = text.index(p) + len(p)
            assert at == len(text)


def test_sections_and_titles(spark):
    md = "# My  title\n\nlead\n\n## One\r\nbody one\n## Two\n\nbody two\n"
    assert [(s, c.rpartition("\n")[2]) for s, c in N.chunk_markdown(md)] == [("Document", "lead"), ("One", "body one"), ("Two", "body two")]
    df = spark.createDataFrame([(1, md), (2, None), (3, "")], "paper_id int, markdown string")
    assert sorted((r.paper_id, r.ordinal, r.section) for r in N.chunks(df).collect()) == [(1, 1, "Document"), (1, 2, "One"), (1, 3, "Two")]
    with pytest.raises(ValueError):
        N.chunk_markdown("x", size=10, overlap=10)


def test_budgets(spark):
    df = spark.createDataFrame([(1, "aaa"), (2, "bbbb"), (3, "c")], "n int, t string")
    assert [r.n for r in N.within_budget(df, ["n"], F.length("t"), 6).collect()] == [1]
    assert [r.t for r in N.cut_to_budget(df, ["n"], "t", 6).orderBy("n").collect()] == ["aaa", "bbb"]


def test_backward_windows(spark):
    df = spark.createDataFrame([(1, 1000), (2, 10)], "d int, n int")
    got = {}
    for r in H.backward_windows(df, "d", F.col("n")).orderBy("d", "window").collect():
        got.setdefault(r.d, []).append((r.start, r.end))
    assert len(got[1]) <= 6 and got[1][0][1] == 1000 and got[1][-1][0] == 400
    assert got[2] == [(4, 10)]


def test_headings(spark):
    md = "# Title\n1. Introduction\n## 1 Introduction\nx\n### 1.2 Scope\nRUN\n## Chapter 3 Results\nRUN\n## Contents\n## Odd words\nRUN\nFig. 1 a\nb\n\n## Conclusion"
    df = spark.createDataFrame([(1, md)], "d int, t string")
    h = H.markdown_headings(df, "d", "t")
    assert [(r.line, r.level) for r in h.orderBy("line").collect()] == [(1, 1), (3, 2), (5, 3), (7, 2), (9, 2), (10, 2), (15, 2)]
    toc = [(r.level, r.title) for r in S.toc(h, "d", F.lit("Title")).orderBy("line").collect()]
    assert toc == [(1, "1 Introduction"), (2, "1.2 Scope"), (1, "3 Results"), (1, "Conclusion")]
    assert [r.title for r in H.running_headers(df, "d", "t").collect()] == ["run"]
    repeated = spark.createDataFrame([(1, "## Run\nrun\nrun\n## run\n# RUN \n## Once\nline\nline\nline"), (2, None)], "d int, t string")
    assert [(r.d, r.title, r.n) for r in H.running_headings(H.markdown_headings(repeated, "d", "t"), "d").collect()] == [(1, "run", 3)]
    assert [r.caption for r in H.captions(df, "d", "t").collect()] == ["Fig. 1 a b"]
    carried = {r.line: r.section for r in H.carry_section(df, "d", "t").collect()}
    assert carried[2] == "Document" and carried[6] == "1 Introduction" and carried[15] == "Conclusion"


# --- sinks and streams


def test_replace_and_append(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace(spark.range(3), path)
    sinks.replace(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]
    sinks.append_new(spark.range(5), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]


def test_upsert(spark):
    f = lambda rows: spark.createDataFrame(rows, "paper_id int, content_hash string, v string")
    stored, new = f([(1, "a", "old"), (2, "b", "old"), (9, "z", "old")]), f([(1, "a", "new"), (2, "c", "new"), (3, "d", "new")])
    assert sorted((r.paper_id, r.v) for r in sinks.upsert(new, stored).collect()) == [(1, "old"), (2, "new"), (3, "new"), (9, "old")]
    assert sorted(r.paper_id for r in sinks.upsert(new, stored, keep_missing=False).collect()) == [1, 2, 3]


def test_index_stream_is_idempotent(spark, tmp_path):
    src, out, ck = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    schema = "paper_id int, content string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(src)
    run = lambda: inc.index_stream(spark.readStream.schema(schema).parquet(src), out, ck).awaitTermination()
    run()
    spark.createDataFrame([(2, "B"), (3, "c")], schema).write.mode("append").parquet(src)
    run()
    run()
    assert sorted((r.paper_id, r.content) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_ingest_stream(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    schema = "pos int, doi string, pmid string, publication_number string, title string, paper_type string"
    spark.createDataFrame([(1, "10.1/a", "", "", "t", "x"), (2, "10.1/A", "", "", "t", "x"), (3, "", "", "", "t", "x")], schema).write.parquet(src)
    existing = spark.createDataFrame([], "id string, doi string, pmid string, publication_number string")
    go = lambda: inc.ingest_stream(spark.readStream.schema(schema).parquet(src), existing, f"file://{tmp_path}/ok", f"file://{tmp_path}/no", f"file://{tmp_path}/ck").awaitTermination()
    go()
    spark.createDataFrame([(4, "doi:10.1/a", "", "", "t", "x"), (5, "10.1/e", "", "", "t", "x")], schema).write.mode("append").parquet(src)
    go()
    assert sorted(r.pos for r in spark.read.parquet(f"file://{tmp_path}/ok").collect()) == [1, 5]
    assert sorted((r.pos, r.status) for r in spark.read.parquet(f"file://{tmp_path}/no").collect()) == [(2, "duplicate"), (3, "pending"), (4, "duplicate")]


def test_event_streams_equal_the_batch(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    source = tmp_path / "events"
    source.mkdir()
    (source / "e.parquet").symlink_to(path)
    stream = spark.readStream.schema(batch.schema).parquet(f"file://{source}")
    got = inc.run_to_table(inc.windowed_counts(stream, "1 day"), "daily", f"file://{tmp_path}/c1", "complete")
    want = inc.windowed_counts(batch, "1 day")
    rows = lambda df: sorted((str(r.started), r.event_type, r.n) for r in df.collect())
    assert rows(got) == rows(want)
    sessions = inc.run_to_table(inc.session_counts(stream, "30 minutes"), "sessions", f"file://{tmp_path}/c2", "complete")
    assert sessions.agg(F.sum("n")).first()[0] == batch.count()
    once = inc.run_to_table(inc.deduplicated(stream.select("ts", "user_id"), ["user_id"], late="60 days"), "once", f"file://{tmp_path}/c3")
    assert once.count() == batch.select("user_id").distinct().count()


def test_silo_stream(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "doi string, n int").write.parquet(src)
    inc.silo_stream(spark.readStream.schema("doi string, n int").parquet(src), out, f"file://{tmp_path}/ck", ["doi"]).awaitTermination()
    assert sorted(r.doi for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_edges_of_a_source_lie_together(spark, tmp_path):
    """Distinct edges, in many small parts by source, so that a scope is met and sources are counted where they lie."""
    from sparquill.plans import graph_queries

    rows = [(i % 50, i % 7) for i in range(3000)] + [(None, 1), (None, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    edges = graph_queries._edges(spark, f"file://{tmp_path}")
    got = [tuple(r) for r in edges.collect()]
    assert len(got) == len(set(got)) and set(got) == {(s, str(t), t) for s, t in rows}
    assert edges.rdd.getNumPartitions() >= graph_queries.LEAST_PARTS
    spread = edges.withColumn("part", F.spark_partition_id()).groupBy("source_id").agg(F.countDistinct("part").alias("n"))
    assert {r.n for r in spread.collect()} == {1}
