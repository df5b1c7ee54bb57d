"""Every query that has SQL against that SQL; the others give rows."""

from __future__ import annotations

import pytest
from compare import compare

from sparquill.plans import corpus_queries, graph_queries, more_queries, search_queries  # noqa: F401
from sparquill.plans.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_equal_the_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), ORACLE[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
