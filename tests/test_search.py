"""Ranking against another BM25, modes, fallback, silo grammar, snippets, rollup."""

from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import proximity
from sparquill.operators import search as S

ROWS = [
    (1, 10, 1, "Turbulence modeling in boundary layers: the boundary matters"),
    (2, 10, 2, "Deep learning for fluid dynamics, and turbulence"),
    (3, 20, 1, "Nothing to see here at all"),
    (4, 20, 2, "Boundary value problems; fluid boundary"),
    (5, 30, 1, "Études of 深度 学习 models, a_b"),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(*r, "body") for r in ROWS], "node_id int, paper_id int, ordinal int, content string, section string")


def _tokens(text):
    return S.query_tokens(text)


def _sqlite(match):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(node UNINDEXED, tokens)")
    con.executemany("INSERT INTO f VALUES (?, ?)", [(r[0], " ".join(_tokens(r[3]))) for r in ROWS])
    return {n: round(-s, 6) for n, s in con.execute("SELECT node, bm25(f) FROM f WHERE f MATCH ?", (match,))}


@pytest.mark.parametrize(("ask", "mode", "require", "match"), [
    ("turbulence fluid", "or", None, '"turbulence" OR "fluid"'),
    ("turbulence fluid", "and", None, '"turbulence" AND "fluid"'),
    ("fluid", "or", ["boundary"], '"boundary" AND ("fluid")'),
    ("the boundary nothing", "or", None, '"the" OR "boundary" OR "nothing"'),
    ("a_b 学习 a", "or", None, '"a_b" OR "学习" OR "a"'),
])
def test_scores_equal_a_full_text_engine(nodes, ask, mode, require, match):
    got = {r.node_id: round(r.score, 6) for r in S.search_nodes(nodes, ask, 10, mode=mode, require=require, fallback=False).collect()}
    assert got == _sqlite(match) and got


def test_stored_postings_rank_alike(nodes):
    post, stats = S.postings(nodes, F.col("content")), S.node_stats(nodes, F.col("content"))
    got = {r.node_id: round(r.score, 6) for r in S.bm25_from_postings(post, stats, ["turbulence", "boundary"]).collect()}
    assert got == _sqlite('"turbulence" OR "boundary"')


def test_tokens_agree_between_driver_and_column(spark):
    texts = ["Étion 深度 学习。模型 a_b A_B x", "", "中", "中 文!文 中", "foo-bar  한국어"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.index_tokens("t").alias("k"))
    assert [r.k for r in df.collect()] == [S.query_tokens(t) for t in texts]
    assert S.query_tokens("Étion 深度 学习") == ["tion", "深度", "度学", "学习"]


def test_fallback_only_when_ranking_finds_nothing(nodes):
    got = S.search_nodes(nodes, "urbulenc", 10).collect()
    assert [(r.node_id, r.score) for r in got] == [(1, -999.0), (2, -999.0)]
    assert S.search_nodes(nodes, "urbulenc", 10, fallback=False).count() == 0
    assert {r.node_id for r in S.search_nodes(nodes, "fluid", 10).collect()} == {2, 4}


def test_scope_limits_and_exclusion(spark, nodes):
    none = spark.createDataFrame([], "paper_id int")
    assert S.search_nodes(nodes, "boundary", 10, scope=none).count() == 0
    one = spark.createDataFrame([(20,), (20,)], "paper_id int")
    assert [r.node_id for r in S.search_nodes(nodes, "boundary", 10, scope=one).collect()] == [4]
    # the word is tested after the limit: the best hit goes and none takes its place
    best = S.search_nodes(nodes, "boundary", 1).first().node_id
    word = "value" if best == 4 else "modeling"
    assert S.search_nodes(nodes, "boundary", 1, exclude=[word]).count() == 0
    assert S.search_nodes(nodes, "", 5).count() == 0


def test_rollup_sums_reciprocal_ranks(nodes):
    got = S.search(nodes, "boundary turbulence fluid", 2, first=["section"]).collect()
    hits = S.search_nodes(nodes, "boundary turbulence fluid", 8).collect()
    want = {}
    for h in hits:
        want[h.paper_id] = want.get(h.paper_id, 0) + 1 / (60 + h["rank"])
    assert [(r.paper_id, round(r.score, 9)) for r in got] == sorted(((k, round(v, 9)) for k, v in want.items()), key=lambda x: -x[1])[:2]
    assert all(len(r.evidence) <= 3 and r.section == "body" for r in got)


def test_snippets(spark):
    long = "x" * 300 + " needle " + "y " * 400
    df = spark.createDataFrame([(long,), ("short  text\n here",), (None,)], "t string")
    a, b, c = [r.s for r in df.select(X.snippet("t", ["needle", "absent"]).alias("s")).collect()]
    assert a.startswith("...") and a.endswith("...") and "needle" in a and len(a) <= 366
    assert b == "short text here" and c == ""


SILO = [("w1", "Fluid dynamics", "A", "Deep learning of fluids"), ("w2", "Graph theory", "B", "Fluid dynamics is absent, deep")]


@pytest.mark.parametrize(("ask", "found"), [
    ("fluid", {"w1", "w2"}), ('"deep learning"', {"w1"}), ("deep NOT learning", {"w2"}), ("graph OR learning", {"w1", "w2"}),
    ("title:fluid", {"w1"}), ("graph AND (deep OR nothing)", {"w2"}), ("learn*", {"w1"}), ('"unclosed', set()), ("fluid dynamics", {"w1", "w2"}), ("nope:fluid", set()),
])
def test_silo_grammar(spark, ask, found):
    df = spark.createDataFrame(SILO, "paper_id string, title string, authors string, abstract string")
    assert {r.paper_id for r in S.silo_search(df, ask).collect()} == found


NEAR_ROWS = [
    ("a", "one two three four five six seven", "", ""), ("b", "seven six one", "two", "x"), ("c", "one x x x two", "", "two y one"), ("d", None, "one", ""),
    ("e", "Two words, then one", "oneself two", None), ("f", "one two one two three", "three " * 30 + "one", ""), ("g", "", "", ""),
]
NEAR_ASKS = [
    "NEAR(one two)", "NEAR(one two, 0)", "NEAR(one two, 2)", "NEAR(one two, 3)", "NEAR(two one, 1)", 'NEAR("one two" three, 0)', 'NEAR("two three" "six seven", 2)', 'NEAR("two three" "six seven", 1)',
    "title : NEAR(one two, 1)", "NEAR(one* two, 0)", "NEAR(one one, 0)", "NEAR(one)", "NEAR(one three, 5) OR seven", "six NOT NEAR(one seven, 5)", "NEAR(one two three, 1)", "NEAR(seven one, 4)",
]


def test_near_is_what_sqlite_finds(spark):
    df = spark.createDataFrame(NEAR_ROWS, "paper_id string, title string, authors string, abstract string")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(paper_id UNINDEXED, title, authors, abstract)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", NEAR_ROWS)
    columns = ["title", "authors", "abstract"]
    got = df.select("paper_id", *[S.expression_filter(a, columns).alias(f"q{i}") for i, a in enumerate(NEAR_ASKS)]).collect()
    for i, ask in enumerate(NEAR_ASKS):
        assert {r.paper_id for r in got if r[f"q{i}"]} == {x for (x,) in db.execute("SELECT paper_id FROM t WHERE t MATCH ?", (ask,))}, ask
    assert {r.paper_id for r in S.silo_search(df, "NEAR(one two, 0)").collect()} == {x for (x,) in db.execute("SELECT paper_id FROM t WHERE t MATCH 'NEAR(one two, 0)'")}
    post = proximity.positions(df, columns, "paper_id")
    for body in ("one two, 0", '"one two" three, 0', "one* two, 0", "one two three, 1", "one one, 0"):
        found = {x for (x,) in db.execute("SELECT paper_id FROM t WHERE t MATCH ?", (f"NEAR({body})",))}
        assert {r.node_id for r in proximity.near_from_positions(post, *proximity.parse_near(body)).collect()} == found, body


def test_near_over_random_texts_and_long_ones(spark):
    rng = random.Random(5)
    rows = [(str(i), " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 25)))) for i in range(150)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, x)")
    db.executemany("INSERT INTO t VALUES (?, ?)", rows)
    df = spark.createDataFrame(rows, "id string, x string")
    asks = ["NEAR(a b c, 1)", 'NEAR("a b" c, 2)', 'NEAR("a b" "c d" e, 4)', "NEAR(a b c d, 0)", 'NEAR("a a" a, 0)']
    got = df.select("id", *[S.expression_filter(a, ["x"]).alias(f"q{i}") for i, a in enumerate(asks)]).collect()
    for i, ask in enumerate(asks):
        assert {r.id for r in got if r[f"q{i}"]} == {x for (x,) in db.execute("SELECT id FROM t WHERE t MATCH ?", (ask,))}, ask
    long = spark.createDataFrame([("far", "a " * 200_000 + "x " * 11 + "b"), ("near", "a " * 200_000 + "x " * 10 + "b")], "id string, x string")
    assert [r.id for r in long.where(S.expression_filter("NEAR(a b)", ["x"])).collect()] == ["near"]


@pytest.mark.parametrize("body", ["", ", 3", "a, b", 'a "', "a, 1, 2", "***"])
def test_near_that_cannot_be_read(body):
    with pytest.raises(ValueError):
        proximity.parse_near(body)
