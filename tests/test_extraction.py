"""Metadata extraction, cards, steps, paged sources."""

from __future__ import annotations

import json

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull, LessThan
from pyspark.sql import functions as F

from sparquill.operators import cards, extraction as E
from sparquill.plans.steps import Registry, StepFailed
from sparquill.sources import connectors


@pytest.mark.parametrize(("lines", "want"), [
    (["# Turbulence Modeling in Boundary Layers"], ("Turbulence Modeling in Boundary Layers", 0)), (["# Abstract", "# Real Title Here"], ("Real Title Here", 1)),
    (["# 1 Introduction", "# A Novel Approach"], ("A Novel Approach", 1)), (["No heading here"], ("", -1)),
    (["# John Smith<sup>1</sup>", "# A Long Title About Turbulence"], ("A Long Title About Turbulence", 1)), (["# 1 Intro", "# Keywords"], ("Keywords", 1)),
])
def test_titles(lines, want):
    assert E.title_of(lines) == want


@pytest.mark.parametrize(("text", "want"), [
    ("https://doi.org/10.1234/test.2023.001", "10.1234/test.2023.001"), ("[DOI: 10.1234/test.2023.001]", "10.1234/test.2023.001"), ("DOI: 10.17632/abc123", ""), ("DOI: 10.5281/zenodo.1", ""),
    ("none", ""), ("DOI: 10.1234/test.2023.001.", "10.1234/test.2023.001"), ("文献DOI: 10.1234/test.2023", "10.1234/test.2023"), ("DOI: 10.1016/S1474-4422(23)00194-1", "10.1016/S1474-4422(23)00194-1"), (None, ""),
])
def test_dois(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(E.doi_in_text("t")).first()[0] == want


def test_dois_of_data_repositories_are_told_by_their_form(spark, tmp_path):
    from compare import compare

    from sparquill.plans.more_queries import text_metadata
    from sparquill.plans.registry import ORACLE

    data = ("10.17632/abc123", "10.17632/8h2yb3gzkx.2", "10.5281/ZENODO.12", "10.6084/m9.figshare.1.v2", "10.5061/dryad.b5mkkwhn1")
    other = ("10.17632/X.16632", "10.5281/X.4281", "10.6084/X.5084", "10.5061/X.4061")
    rows = spark.createDataFrame([(f"see {d}.",) for d in data + other], "t string")
    assert [r[0] for r in rows.select(E.doi_in_text("t")).collect()] == [""] * len(data) + list(other)
    spark.createDataFrame([(k,) for k in (1, 4061, 4281, 5084, 16632)], "doc_id long").coalesce(1).write.parquet(f"file://{tmp_path}/made")
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    assert compare(text_metadata(spark, f"{tmp_path}"), ORACLE["text_metadata"], str(tmp_path)) == []


@pytest.mark.parametrize(("text", "want"), [("Copyright © 2023", 2023), ("Received 15 March 2022", 2022), ("Cite as: Smith et al. (2024)", 2024), ("Vol. 950, 2023", 2023), ("Copyright 1899", None), ("Copyright 2099", None), ("No year", None)])
def test_years(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(E.year_in_text("t")).first()[0] == want


def test_names():
    assert E.clean_author_text("B I J L A R D") == "BIJLARD" and "and" in E.clean_author_text("SMITH A N D JONES") and "@" not in E.clean_author_text("Smith user@example.com")
    assert [E.clean_author(n) for n in ("Smith*†", "By John Smith", "Smith (MIT)")] == ["Smith", "John Smith", "Smith"]
    assert E.split_authors("Smith; Doe; Wang") == ["Smith", "Doe", "Wang"] and E.split_authors("张三，李四，王五") == ["张三", "李四", "王五"]
    names = ["John Smith", "S. Balachandar", "J. K. Eaton", "Marco de Vanna", "Milton van Dyke", "张三", ""]
    assert [E.last_name(n) for n in names] == ["Smith", "Balachandar", "Eaton", "De Vanna", "Van Dyke", "张", ""]
    assert E.journal_of("in Nature Communications") == "Nature Communications" and E.journal_of("Phys. Fluids 35") == "Phys. Fluids" and E.journal_of("random") == ""
    assert E.from_file_name("MinerU_markdown_Smith-2023-Turbulence_1234567890.md") == {"first_author_lastname": "Smith", "year": 2023, "title": "Turbulence"} and E.from_file_name("random_name.md") == {}


def test_stems(spark):
    assert E.stem("Smith", 2023, "Turbulence Modeling") == "Smith-2023-Turbulence-Modeling"
    assert E.stem(None, 2023, "Test").startswith("Unknown-") and "XXXX" in E.stem("Smith", None, "T") and E.stem("Jiménez", 2020, "Flow").startswith("Jimenez")
    odd = r"$\mathrm{La}{\mathrm{BH}}_8$: Towards high-${T}_c$ low-pressure &#x007B;x&#x007D; <mml:math>y</mml:math>"
    assert not set("$\\{}<>&:") & set(E.stem("Song", 2023, odd)) and E.file_title("") == "Untitled"
    for title in ("Word " * 100, "测试" * 200):
        assert len(E.stem("王", 2024, title).encode()) <= 251
    df = E.with_stem(spark.createDataFrame([("Smith", 2023, "A b"), (None, None, None)], "first_author_lastname string, year int, title string"))
    assert [r.stem for r in df.collect()] == ["Smith-2023-A-b", "Unknown-XXXX-Untitled"]


def test_full_extraction(spark):
    md = "# A Novel Turbulence Model\n\nJohn Smith, Jane Doe\n\nDOI: 10.1234/test.2023\n\nCopyright © 2023\n\nJournal of Fluid Mechanics\n\n## Abstract\n\nSome abstract.\n"
    df = spark.createDataFrame([("a", md), ("b", ""), ("c", None)], "dir_name string, markdown string")
    got = {r.dir_name: r for r in E.extract(df).collect()}
    assert (got["a"].title, got["a"].doi, got["a"].year, got["a"].authors, got["a"].first_author_lastname) == ("A Novel Turbulence Model", "10.1234/test.2023", 2023, ["John Smith", "Jane Doe"], "Smith")
    assert (got["b"].title, got["b"].doi, got["b"].year, got["b"].authors) == ("", "", None, []) == (got["c"].title, got["c"].doi, got["c"].year, got["c"].authors)

    def reader(text, found):
        if not text:
            raise RuntimeError("no answer")
        return {"title": found["title"].upper(), "other": 1}

    got = {r.dir_name: r for r in E.extract(df, then=reader).collect()}
    assert got["a"].title == "A NOVEL TURBULENCE MODEL" and got["b"].error == "no answer"


def test_types_and_refetch(spark):
    rows = [("A patent on x", "", "", ""), ("Doctoral dissertation", "", "", ""), ("Handbook of y", "", "", ""), ("z", "", "", "see CN 123456789 A here"), ("z", "", "CN1", ""), ("plain", "review", "", "")]
    df = spark.createDataFrame(rows, "title string, paper_type string, publication_number string, t string")
    assert [r.k for r in df.select(E.document_type("title", "paper_type", "publication_number", "t").alias("k")).collect()] == ["patent", "thesis", "book", "patent", "patent", None]
    rows = [("d", {"x": 1}, "1", "p", ["r"]), ("d", {}, "1", "p", ["r"]), ("d", {"x": 1}, None, "p", ["r"]), ("d", {"x": 1}, "1", "p", None), ("", {}, "", "", [])]
    df = spark.createDataFrame(rows, "doi string, citation_count map<string,bigint>, volume string, publisher string, references array<string>")
    assert [r.n for r in df.select(E.needs_refetch().alias("n")).collect()] == [False, True, True, True, False]


def test_json_and_layouts(spark):
    assert E.tolerant_json('```json\n{"a": "\\alpha"}\n```') == {"a": "\\alpha"}
    with pytest.raises(ValueError):
        E.tolerant_json("[1]")
    tree = {"pages": [{"type": "Section-Title", "text": "One", "level": "h2"}, {"kind": "para", "text": "no", "children": [{"text_level": 5, "content": "Deep"}]}]}
    df = spark.createDataFrame([("a", json.dumps(tree)), ("b", "{broken"), ("c", None)], "dir_name string, json string")
    assert [(r.dir_name, r.text, r.level) for r in E.layout_heading_rows(df).orderBy("position").collect()] == [("a", "One", 2), ("a", "Deep", 3)]


def test_cards(spark):
    body = "We saw 12 patients improve. However, the sample was small. however, the sample was small. " * 2
    md = f"# T\n## Results\nx\n## 5 Conclusions\n{body}\n## References\n[1]"
    rows = [("a", md, "review"), ("b", md, "book"), ("c", "", "x"), ("d", "plain", "x"), ("e", "# T\n## Results\nx", "x"), ("f", "# T\n## Conclusion\nshort", "x")]
    df = spark.createDataFrame(rows, "dir_name string, markdown string, paper_type string")
    made = cards.cards(df).cache()
    got = {r.dir_name: r for r in made.collect()}
    assert {k: (r.status, r.reason) for k, r in got.items()} == {"a": ("ok", None), "b": ("skipped", None), "c": ("failed", "no_text"), "d": ("failed", "no_headings"), "e": ("failed", "no_conclusion"), "f": ("failed", "too_short")}
    assert [q.text for q in got["a"].card.quantitative_signals] == ["We saw 12 patients improve."] and got["a"].card.limitations == ["However, the sample was small."]
    text = made.where("dir_name = 'a'").select(cards.render().alias("t")).first().t
    assert text.startswith("Mode: explicit_section | Confidence: high\n\nTakeaway:\nWe saw 12") and "Quantitative signals:\n- We saw 12 patients improve. [5 Conclusions]" in text
    bare = made.where("dir_name = 'a'").withColumn("card", F.col("card").withField("quantitative_signals", F.array().cast("array<struct<text:string,source:string>>")).withField("limitations", F.array().cast("array<string>")))
    assert bare.select(cards.render().alias("t")).first().t == body.strip()
    assert made.where("dir_name = 'c'").select(cards.render().alias("t")).first().t is None


def test_steps(spark):
    r = Registry()
    r.add("index", "global", lambda df: df.withColumn("i", F.lit(1)))
    r.add("clean", "inbox", lambda df: df.where("id > 0"))
    r.add("bad", "papers", lambda df: df.select("nothing"))
    r.preset("all", ["index", "clean"])
    assert r.plan("all") == ["clean", "index"] and r.run(spark.range(3), "all").collect() == [(1, 1), (2, 1)]
    df, log = r.run_timed(spark.range(3), ["clean", "bad", "index"], lambda d, n: d.cache(), keep_going=True)
    assert [x["status"].split(":")[0] for x in log] == ["ok", "failed", "ok"] and df.count() == 2
    with pytest.raises(StepFailed) as failed:
        r.run_timed(spark.range(3), ["clean", "bad", "index"], lambda d, n: d.cache())
    assert [x["step"] for x in failed.value.log] == ["clean", "bad"]
    for wrong in (lambda: r.add("x", "nowhere", None), lambda: r.preset("p", ["none"]), lambda: r.plan(["none"])):
        with pytest.raises(ValueError):
            wrong()


def test_paged_sources(spark, tmp_path):
    saved = [{"results": [{"id": f"W{2 * p + i}", "title": "t", "cited_by_count": i} for i in range(2)], "meta": {"next_cursor": str(p + 1) if p < 2 else None}} for p in range(3)]
    for i, page in enumerate(saved):
        (tmp_path / f"page-{i}.json").write_text(json.dumps(page))
    spark.dataSource.register(connectors.PagedWorks)
    df = spark.read.format("paged_works").option("path", str(tmp_path)).load()
    assert sorted(r.id for r in df.collect()) == [f"W{i}" for i in range(6)]
    for most, given in ((1, 1), (3, 3), (4, 4), (50, 6)):
        some = spark.read.format("paged_works").options(path=str(tmp_path), limit=most).load()
        assert sorted(r.id for r in some.collect()) == [f"W{i}" for i in range(given)]
    fails = iter([True, True, False, False, False])

    def fetch(cursor):
        if next(fails):
            raise OSError("busy")
        return saved[0 if cursor == "*" else int(cursor)]

    pauses: list[float] = []
    assert [w["id"] for w in connectors.pages(fetch, 5, sleep=pauses.append)] == [f"W{i}" for i in range(5)] and pauses == [1.0, 2.0]
    with pytest.raises(OSError):
        connectors.with_retries(lambda: (_ for _ in ()).throw(OSError("down")), sleep=pauses.append)


def test_conditions_reach_the_paged_reader(spark, tmp_path):
    years = [2018, 2019, None, 2020, 2021, 2022]
    for p in range(3):
        (tmp_path / f"page-{p}.json").write_text(json.dumps({"results": [{"id": f"W{i}", "title": "t", "publication_year": years[i], "cited_by_count": i} for i in (2 * p, 2 * p + 1)]}))
    spark.dataSource.register(connectors.PagedWorks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for where in ("publication_year = 2020", "publication_year >= 2020 and cited_by_count < 5", "publication_year > 2018 and title = 't'", "cited_by_count <= 2", "publication_year is null", "2019 < publication_year or cited_by_count = 0"):
            plain, pushed, few = (spark.read.format("paged_works").options(path=str(tmp_path), **o).load().where(where) for o in ({}, {"pushdown": "true"}, {"pushdown": "true", "limit": "4"}))
            want = sorted(r.id for r in plain.collect())
            assert sorted(r.id for r in pushed.collect()) == want, where
            assert sorted(r.id for r in few.collect()) == [i for i in want if i < "W4"], where
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = connectors.PagedWorks({"path": str(tmp_path), "pushdown": "true"}).reader(None)
    rest = [EqualTo(("title",), "t"), IsNotNull(("publication_year",))]
    assert list(reader.pushFilters([GreaterThanOrEqual(("publication_year",), 2020), *rest, LessThan(("cited_by_count",), 5)])) == rest
    assert reader.asked == "publication_year:>2019,cited_by_count:<5"
    assert [w[0] for part in reader.partitions() for w in reader.read(part)] == ["W3", "W4"]


def test_texts_are_inverted_where_they_are(spark, tmp_path):
    """Null, empty and blank texts, repeated ids and words; no text is taken apart over a shuffle."""
    from compare import compare

    from sparquill.functions import text as X
    from sparquill.plans.corpus_queries import inverted_abstract
    from sparquill.plans.registry import ORACLE

    texts = ["b a b", "", " ", None, "  x  x ", "a\nb é 深", "b a b", " ".join(f"w{i % 97}" for i in range(3000))]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert docs.select(X.text_to_inverted("text")).first()[0] == {"a": [1], "b": [0, 2]}
    docs.write.parquet(f"file://{tmp_path}/made")
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    found = inverted_abstract(spark, f"{tmp_path}")
    assert compare(found, ORACLE["inverted_abstract"], str(tmp_path)) == []
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
