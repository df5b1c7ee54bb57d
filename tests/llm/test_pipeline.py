"""The pipeline against its stages done by hand, and the registered queries."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from sparquill.session import table

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect_in_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language_id", "near_duplicates", "packing"]
    held = docs
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, held, sf_dir)
        assert out.columns == docs.columns
        kept = {r.doc_id for r in out.collect()}
        assert kept < {r.doc_id for r in held.collect()} or kept == {r.doc_id for r in held.collect()}
        held = out
    packed = pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
    texts = [r.text for r in held.collect()]
    assert len(set(texts)) == len(texts)


def test_odd_documents_pass(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        held = docs
        for _, stage in pipeline.STAGES:
            held = stage(spark, held, f"file://{tmp_path}")
        held.collect()


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op1_maxscore_topk", "op4_warc_dictionary"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    from compare import compare

    assert compare(entry.queries()[name](spark, sf_dir), entry.oracle_sql()[name], sf_dir) == []
