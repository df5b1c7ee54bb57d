"""Tables in buckets and the stored inverted index."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import inverted, search
from sparquill.sources import sinks
from sparquill.streaming import incremental


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    path, kind = f"file://{tmp_path}/t", "paper_id long, content_hash string, v string"
    made = lambda rows: spark.createDataFrame(rows, kind)
    sinks.upsert_buckets(made([(i, f"h{i}", "old") for i in range(400)] + [(None, "x", "x")]), path, buckets=16)
    before = _files(tmp_path / "t")
    batch = made([(5, "new", "new"), (6, "h6", "same digest"), (1000, "n", "new"), (1000, "z", "twice")])
    assert 1 <= sinks.upsert_buckets(batch, path, batch=1, buckets=16) <= 2
    after = _files(tmp_path / "t")
    kept = {f for f in before if after.get(f) == before[f]}
    assert len({os.path.dirname(f) for f in kept}) >= 14
    rows = {r.paper_id: (r.content_hash, r.v, r.batch) for r in sinks.read_buckets(spark, path, 16).collect()}
    assert len(rows) == 401 and rows[5] == ("new", "new", 1) and rows[6] == ("h6", "old", 0) and rows[1000] == ("n", "new", 1)
    assert sinks.upsert_buckets(batch, path, batch=2, buckets=16) == 0 and _files(tmp_path / "t") == after
    assert sinks.upsert_buckets(made([]), path, batch=3, buckets=16, gone=spark.createDataFrame([(7,), (8888,)], "paper_id long")) == 1
    assert sinks.read_buckets(spark, path, 16).count() == 400
    with pytest.raises(ValueError):
        sinks.read_buckets(spark, path, 8)


def test_a_bucket_that_loses_its_last_row(spark, tmp_path):
    path, kind = f"file://{tmp_path}/t", "paper_id long, content_hash string"
    sinks.upsert_buckets(spark.createDataFrame([(1, "a"), (2, "b")], kind), path, buckets=64)
    sinks.upsert_buckets(spark.createDataFrame([], kind), path, buckets=64, gone=spark.createDataFrame([(1,)], "paper_id long"))
    assert [r.paper_id for r in sinks.read_buckets(spark, path).collect()] == [2]


def _want(spark, nodes, terms):
    have = spark.createDataFrame(list(nodes.items()), "node_id long, content string")
    found = search.bm25(have.select("node_id", X.index_terms("content").alias("tokens")), terms)
    return {r.node_id: round(r.score, 9) for r in found.collect()}


def _got(spark, path, terms):
    return {r.node_id: round(r.score, 9) for r in inverted.scores(spark, path, terms).collect()}


def test_scores_after_each_batch_equal_a_fresh_index(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(12)] + ["a_b", "w1_w2", "深度学习"]
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(14)))
    path, nodes, terms = f"file://{tmp_path}/i", {}, ["w1", "a", "b", "深度", "nowhere", "w2"]
    assert _got(spark, path, terms) == {}
    for batch in range(3):
        part = {rng.randrange(60): text() for _ in range(40)} | {100: None, 101: ""}
        df = spark.createDataFrame(list(part.items()), "node_id long, content string")
        inverted.update(df, path, batch)
        nodes |= part
        assert _got(spark, path, terms) == _want(spark, nodes, terms)
        files = _files(tmp_path)
        assert inverted.update(df, path, batch + 100) == 0 and _files(tmp_path) == files
    nodes = {k: v for k, v in nodes.items() if k % 3}
    inverted.update(spark.createDataFrame(list(nodes.items()), "node_id long, content string"), path, 7, keep_missing=False)
    assert _got(spark, path, terms) == _want(spark, nodes, terms) != {}
    inverted.compact(spark, path)
    assert _got(spark, path, terms) == _want(spark, nodes, terms)
    assert spark.read.parquet(f"{path}/postings").where("f = 0").count() == 0
    inverted.update(spark.createDataFrame([(1, "w1 w1_w2")], "node_id long, content string"), path, 8)
    assert _got(spark, path, terms) == _want(spark, nodes | {1: "w1 w1_w2"}, terms)


def test_a_failed_batch_runs_again(spark, tmp_path, monkeypatch):
    """Postings are written, the forward table isn't: the same batch again ends right."""
    path = f"file://{tmp_path}/i"
    inverted.update(spark.createDataFrame([(1, "one two"), (2, "two")], "node_id long, content string"), path, 0)
    second = spark.createDataFrame([(1, "two three"), (3, "three")], "node_id long, content string")
    with monkeypatch.context() as m:
        m.setattr(sinks, "upsert_buckets", lambda *a, **b: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            inverted.update(second, path, 1)
    inverted.update(second, path, 1)
    terms = ["one", "two", "three"]
    assert _got(spark, path, terms) == _want(spark, {1: "two three", 2: "two", 3: "three"}, terms)


def test_new_nodes_are_appended(spark, tmp_path):
    """Nothing that is stored is written again for a batch of new nodes, and nodes that come again unchanged write nothing."""
    path, kind = f"file://{tmp_path}/i", "node_id long, content string"
    nodes = {i: f"w{i % 7} common w{i % 3}" for i in range(90)}
    inverted.update(spark.createDataFrame([(i, nodes[i]) for i in range(60)], kind), path, 0)
    before = _files(tmp_path / "i")
    assert inverted.update(spark.createDataFrame([*nodes.items(), (3, nodes[3]), (None, "w1")], kind), path, 1) == 30
    after = _files(tmp_path / "i")
    assert {f: after.get(f) for f in before} == before
    assert _got(spark, path, ["w1", "common", "w2"]) == _want(spark, nodes, ["w1", "common", "w2"])


def test_a_search_reads_its_terms_folders_only(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    inverted.update(spark.createDataFrame([(i, f"word{i} common") for i in range(200)], "node_id long, content string"), path, 0)
    plan = inverted.scores(spark, path, ["word5"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#", plan) and "EqualTo(token,word5)" in plan
    assert "forward" not in plan and "content" not in plan
    assert inverted.lists(spark, path, ["word5"]).count() == 1 and inverted.lists(spark, path, []).count() == 0


def test_index_streams(spark, tmp_path):
    src, kind = f"file://{tmp_path}/in", "node_id long, content string"
    spark.createDataFrame([(1, "one two"), (2, "two")], kind).write.parquet(src)
    go = lambda: incremental.search_stream(spark.readStream.schema(kind).parquet(src), f"file://{tmp_path}/i", f"file://{tmp_path}/ck").awaitTermination()
    go()
    spark.createDataFrame([(2, "three"), (3, "one")], kind).write.mode("append").parquet(src)
    go()
    terms = ["one", "two", "three"]
    assert _got(spark, f"file://{tmp_path}/i", terms) == _want(spark, {1: "one two", 2: "three", 3: "one"}, terms)
    assert spark.read.parquet(f"file://{tmp_path}/i/totals").agg(F.sum("nodes")).first()[0] == 3
