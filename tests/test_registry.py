"""Registry upserts, lists by id, filters of the service, citations by substring."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import identity, nodes
from sparquill.plans.corpus_queries import check_citations
from sparquill.sources import library


def test_upsert_keeps_the_last_row_and_the_first_key(spark):
    registry = spark.createDataFrame([(1, "a", "5", ""), (2, "b", "6", "p")], "id long, title string, pmid string, publication_number string")
    incoming = spark.createDataFrame([(1, "a2", "6", "", 0), (3, "c", "7", "p", 1), (1, "a3", "7", None, 2), (4, "d", "7", "", 3)], "id long, title string, pmid string, publication_number string, pos long")
    got = identity.upsert_registry(registry, incoming).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a3", "", ""), (2, "b", "6", "p"), (3, "c", "7", ""), (4, "d", "", "")]
    assert identity.upsert_registry(registry, incoming.where("false")).count() == 2


def test_lists_and_listings(spark):
    have = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "node_id string, n long")
    wanted = spark.createDataFrame([("z", 0), ("gone", 1), ("x", 2)], "node_id string, pos int")
    assert [r.node_id for r in nodes.by_ids(have, wanted).collect()] == ["z", "x"]
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("m", 0, "one")], "key string, line int, v string")
    assert {r.v for r in identity.last_of(rows, "key", "line").collect()} == {"new", "one"}
    known = spark.createDataFrame([(1, 2020, "b"), (2, None, "a"), (3, 2020, "a"), (4, 2021, "z")], "id int, year int, dir_name string")
    assert [r.id for r in identity.listing(known).collect()] == [4, 3, 1, 2]


def test_filters_of_the_service():
    asked = library.works_filter(issn="1-2", concept="C1", topic="T1", author="A1", institution="I1", source_type="journal", years="2020-", min_citations=3, work_type="review")
    assert asked == "primary_location.source.issn:1-2,concepts.id:C1,topics.id:T1,authorships.author.id:A1,authorships.institutions.id:I1,primary_location.source.type:journal,publication_year:2020-,cited_by_count:>2,type:review"
    assert library.works_filter(min_citations=0, author=None) == ""
    with pytest.raises(TypeError):
        library.works_filter(keyword="x")


def test_citations_meet_names_that_hold_the_surname(spark):
    papers = spark.createDataFrame([(1, "Smithson, A; Li, B", "2020"), (2, "Smith, C", "2020"), (3, "Smith, C", "2019"), (4, None, "2020"), (5, "", "2020")], "id long, authors string, year string")
    cites = spark.createDataFrame([("Smith et al.", "2020"), ("Smith", "2019"), ("Li", "2020"), ("Doe", "2020"), (" et al.", "2020")], "author string, year string")
    got = {(r.author, r.year): (r.n_matches, r.status) for r in check_citations(cites, papers).collect()}
    assert got[("Smith et al.", "2020")] == (2, "AMBIGUOUS") and got[("Smith", "2019")] == (1, "VERIFIED")
    assert got[("Li", "2020")] == (1, "VERIFIED") and got[("Doe", "2020")] == (0, "NOT_IN_LIBRARY")
    assert len(got) == 5


def test_grams(spark):
    row = spark.createDataFrame([("abcab",)], "t string").select(X.grams("t").alias("g")).first()
    assert sorted(row.g) == sorted({"abcab"[i : i + n] for i in range(5) for n in range(1, 5) if i + n <= 5})


def test_surnames_of_any_length_meet_all_papers_of_a_name(spark):
    """Surnames of one character to more than the join's key, papers that share their authors, characters beyond two bytes."""
    long = "Abcdefghij-klmnopqrst-uvwxyz"
    rows = [(i, "Smith, C; Li, B", "2020") for i in range(5)] + [(9, f"{long}-Smith, A", "2020"), (10, f"{long[:-1]}q, B", "2020"), (11, "𝒳yz, É", "2020"), (12, "Li", None)]
    papers = spark.createDataFrame(rows, "id long, authors string, year string")
    cites = spark.createDataFrame([(a, "2020") for a in ("S", "Smith & Doe", "smith", long, long[:24], "𝒳y", "É", "Li, B")] + [("Li", None)], "author string, year string")
    got = {(r.author, r.year): r.n_matches for r in check_citations(cites, papers).collect()}
    assert got == {("S", "2020"): 7, ("Smith & Doe", "2020"): 6, ("smith", "2020"): 6, (long, "2020"): 1, (long[:24], "2020"): 2, ("𝒳y", "2020"): 1, ("É", "2020"): 1, ("Li, B", "2020"): 5, ("Li", None): 0}
    assert check_citations(cites.limit(0), papers).count() == 0


def test_substrings_of_names_are_not_broadcast(spark, tmp_path):
    """Papers that are small as a file aren't once their substrings are listed."""
    papers = spark.range(20_000).select("id", F.concat(F.md5(F.col("id").cast("string")), F.lit("x" * 40)).alias("authors"), F.lit("2020").alias("year"))
    papers.write.parquet(f"file://{tmp_path}/papers")
    papers = spark.read.parquet(f"file://{tmp_path}/papers")
    cites = papers.select(F.substring("authors", 1, 12).alias("author"), "year").distinct()
    found = check_citations(cites, papers)
    assert found.agg(F.min("n_matches")).first()[0] == 1

    def check(plan, above):
        """Substrings are summed before they meet a join."""
        name = plan.nodeName()
        assert name != "Generate" or above == "Aggregate"
        children = plan.children()
        for i in range(children.length()):
            check(children.apply(i), name if name in ("Join", "Aggregate") else above)

    check(found._jdf.queryExecution().optimizedPlan(), "")
