"""Reading a library from files, identity, audit, exports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.functions.dates import parse_year_range
from sparquill.operators import audit, exports, graph, identity, workspace
from sparquill.sources import library, sinks

A = {
    "id": "rec-07", "title": "Peatland carbon under shifting rainfall", "authors": ["Ngozi Okafor", "Lena Brandt"], "first_author_lastname": "Okafor", "year": 2019,
    "journal": "Annals of Wetland Ecology", "doi": "10.5555/awe.2019.88", "pmid": "30111222", "abstract": "Drained bogs lose carbon in dry summers; we follow twelve of them.",
    "paper_type": "journal-article", "citation_count": {"crossref": 3, "s2": 4}, "ids": {"pmid": "30111222"}, "volume": "41", "issue": "7", "pages": "5-29",
    "publisher": "Harbour Press", "issn": "2049-3630", "references": ["10.5555/first", {"DOI": "10.5555/Other"}],
}
B = {"id": "rec-19", "title": "Glacier melt seen from low orbit", "authors": ["Rui Silva"], "first_author_lastname": "Silva", "year": 2021, "journal": "", "doi": "", "abstract": "A thesis on ice loss, from images of small satellites.", "paper_type": "thesis", "citation_count": {}}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("papers")
    for name, meta, md in (("Okafor-2019-Peatland", A, "# Peatland carbon under shifting rainfall\n\nCores were taken each spring. " + "x " * 120), ("Silva-2021-Glacier", B, "# Glacier melt seen from low orbit\n\nImages were taken each week. " + "y " * 120)):
        (top / name).mkdir()
        (top / name / "meta.json").write_text(json.dumps(meta))
        (top / name / "paper.md").write_bytes(md.encode() + b" \xff")
    (top / "Broken-2020-X").mkdir()
    (top / "Broken-2020-X" / "meta.json").write_text("{not json")
    (top / "no-record").mkdir()
    return f"file://{top}"


@pytest.fixture(scope="module")
def papers(spark, root):
    return library.papers(spark, root).cache()


def test_records_texts_and_layers(papers):
    rows = {r.dir_name: r for r in papers.collect()}
    assert set(rows) == {"Okafor-2019-Peatland", "Silva-2021-Glacier", "Broken-2020-X"}
    assert rows["Broken-2020-X"].corrupt and not rows["Okafor-2019-Peatland"].corrupt
    assert rows["Okafor-2019-Peatland"].markdown.startswith("# Peatland") and "�" in rows["Okafor-2019-Peatland"].markdown
    one = {r.paper_id: r for r in library.layer1(papers).collect()}
    assert one["rec-07"].citations == 4 and one["rec-19"].citations == 0 and one["Broken-2020-X"].authors == []
    two = {r.dir_name: r.abstract for r in library.layer2(papers).collect()}
    assert two["Broken-2020-X"] == "[No abstract available]"


def test_references_may_be_objects(papers):
    row = papers.where("id = 'rec-07'").select(graph.reference_dois("references").alias("r")).first()
    assert row.r == ["10.5555/first", "10.5555/other"]


def test_lookups_and_uniqueness(spark, papers):
    registry = papers.where("not corrupt").select("id", "dir_name", "doi", "pmid", F.lit("").alias("publication_number"), "title")
    ask = spark.createDataFrame([("rec-07",), ("Silva-2021-Glacier",), ("https://doi.org/10.5555/AWE.2019.88",), ("PMID: 30111222",), ("Okafor-2019",), ("none",)], "name string")
    got = {r["name"]: (r.id, r.matched_by) for r in identity.lookup(ask, registry, prefix=True).collect()}
    assert got == {
        "rec-07": ("rec-07", "id"), "Silva-2021-Glacier": ("rec-19", "dir_name"), "https://doi.org/10.5555/AWE.2019.88": ("rec-07", "doi"),
        "PMID: 30111222": ("rec-07", "pmid"), "Okafor-2019": ("rec-07", "prefix"),
    }
    titles = spark.createDataFrame([("peatland  CARBON under shifting rainfall",), ("nothing",)], "name string")
    matched = identity.exact_matches(titles, registry)
    summary = {r["name"]: (r.match_count, r.found, r.ambiguous) for r in identity.match_summary(titles, matched).collect()}
    assert summary == {"peatland  CARBON under shifting rainfall": (1, True, False), "nothing": (0, False, False)}
    rows = spark.createDataFrame([(1, "5", "p"), (2, "5", ""), (3, "", "p")], "id int, pmid string, publication_number string")
    assert [(r.id, r.pmid, r.publication_number) for r in identity.unique_identifiers(rows).orderBy("id").collect()] == [(1, "5", "p"), (2, "", ""), (3, "", "")]


def test_ingest_decisions(spark):
    have = spark.createDataFrame([("old", "10.1/a", "", "")], "id string, doi string, pmid string, publication_number string")
    new = spark.createDataFrame([(1, "doi:10.1/A", "", "", "t", "x"), (2, "10.1/b", "", "", "t", "x"), (3, "https://doi.org/10.1/B", "", "", "t", "x"), (4, "", "", "", "t", "x"), (5, "", "", "", "t", "thesis"), (6, "10.1/c", "", "", " ", "x")], "pos int, doi string, pmid string, publication_number string, title string, paper_type string")
    got = {r.pos: (r.status, r.issue, r.duplicate_of) for r in identity.ingest_decision(new, have).collect()}
    assert got == {1: ("duplicate", "in_library", "old"), 2: ("ingested", None, None), 3: ("duplicate", "in_batch", None), 4: ("pending", "no_identifier", None), 5: ("ingested", None, None), 6: ("pending", "no_title", None)}


def test_audit(spark, papers):
    ready = papers.withColumn("n_authors", F.size(F.coalesce("authors", F.array().cast("array<string>"))))
    got = {(r.paper_id, r.rule) for r in audit.issues(ready).collect()}
    assert got == {("Broken-2020-X", "invalid_json"), ("Silva-2021-Glacier", "missing_journal")}
    low = ready.where("id = 'rec-07'").withColumn("dir_name", F.lit("PMID-30111222-Soil")).withColumn("doi", F.lit(""))
    assert {r.rule for r in audit.issues(low).collect()} == {"missing_doi", "nonstandard_filename", "low_info_dir_name"}
    wrong = ready.where("id = 'rec-07'").withColumn("markdown", F.lit("# Completely different heading words\n" + "z " * 200))
    assert {r.rule for r in audit.issues(wrong).collect()} == {"title_mismatch"}
    twice = ready.where("id = 'rec-07'").unionByName(ready.where("id = 'rec-07'").withColumn("dir_name", F.lit("Okafor-2019-Peatland-2")))
    assert audit.issues(twice).where("rule = 'duplicate_doi'").count() == 2
    assert "error: duplicate_doi 2" in audit.report(audit.issues(twice))


def test_exports(spark, papers):
    good = papers.where("not corrupt").orderBy("id")
    first, second = [r.b for r in good.select(exports.bibtex().alias("b")).collect()]
    assert first.startswith("@article{Okafor2019Peatland,\n  title = {{Peatland carbon under shifting rainfall}},\n  author = {Ngozi Okafor and Lena Brandt},") and first.endswith("\n}")
    assert second.startswith("@phdthesis{Silva2021Glacier,") and "journal" not in second
    ris = [r.b for r in good.select(exports.ris().alias("b")).collect()]
    assert ris[0].split("\n")[:4] == ["TY  - JOUR", "TI  - Peatland carbon under shifting rainfall", "AU  - Ngozi Okafor", "AU  - Lena Brandt"]
    assert "SP  - 5\nEP  - 29" in ris[0] and ris[1].startswith("TY  - THES") and ris[1].endswith("ER  -")
    assert exports.select_records(good, "2021-").count() == 1 and exports.select_records(good, journal="wetland").count() == 1
    lines = [r.line for r in exports.reference_list(good, "apa", numbered=True).orderBy("position").collect()]
    assert lines[0] == "1. Rui Silva (2021). Glacier melt seen from low orbit."
    assert lines[1] == "2. Ngozi Okafor, & Lena Brandt (2019). Peatland carbon under shifting rainfall. *Annals of Wetland Ecology*, *41*(7), 5-29. https://doi.org/10.5555/awe.2019.88"
    text = sinks.joined_text(good.select("id", exports.bibtex().alias("b")), "b", ["id"])
    assert text.count("@") == 2 and text.endswith("}\n")


@pytest.mark.parametrize(("style", "n", "start"), [
    ("apa", 0, "Unknown (2020)."), ("apa", 3, "A, B, C, D, & E, F (2020)."), ("apa", 4, "A, B et al. (2020)."),
    ("vancouver", 7, "A B, C D, E F, G H, I J, K L, et al. T."), ("vancouver", 2, "A B, C D. T."),
    ("chicago-author-date", 2, 'A, B, and D C. 2020. "T."'), ("chicago-author-date", 3, 'A, B, D C, and F E. 2020. "T."'), ("chicago-author-date", 4, 'A, B et al. 2020. "T."'),
    ("mla", 1, 'A, B. "T."'), ("mla", 2, 'A, B, and D C. "T."'), ("mla", 3, 'A, B, et al. "T."'),
])
def test_styles(spark, style, n, start):
    names = [f"{a}, {b}" for a, b in ("AB", "CD", "EF", "GH", "IJ", "KL", "MN")][:n]
    df = spark.createDataFrame([("1", "T", names, 2020)], "id string, title string, authors array<string>, year int")
    for c in ("journal", "volume", "issue", "pages", "doi"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    assert exports.formatted(df, style).first().reference.startswith(start)


def test_custom_styles(spark):
    with pytest.raises(ValueError):
        exports.register_style("../x", str)
    with pytest.raises(ValueError):
        exports.register_style("apa", str)
    exports.register_style("plain", lambda r: f"{r['title']} ({r['year']})")
    df = spark.createDataFrame([("T", 2020)], "title string, year int")
    assert exports.formatted(df, "plain").first().reference == "T (2020)" and "plain" in exports.styles()
    with pytest.raises(ValueError):
        exports.formatted(df, "nowhere")


@pytest.mark.parametrize(("text", "want"), [("2023", (2023, 2023)), ("2020-2024", (2020, 2024)), ("2020-", (2020, None)), ("-2024", (None, 2024))])
def test_year_ranges(text, want):
    assert parse_year_range(text) == want


@pytest.mark.parametrize("text", ["", "-", "20", "2020-x", "2020 2021"])
def test_bad_year_ranges(text):
    with pytest.raises(ValueError):
        parse_year_range(text)


def test_workspaces(spark):
    rows = spark.createDataFrame([("w", 0, "a", "x"), ("w", 1, "b", "DUP-y"), ("w", 2, "a", "x"), ("w", 3, None, "z")], "ws string, pos int, id string, dir_name string")
    kept = workspace.entries_dedup(rows)
    assert [(r.id, r.pos) for r in kept.collect()] == [("a", 0)]
    more = spark.createDataFrame([("w", 0, "a", "x"), ("w", 1, "c", "q"), ("v", 0, "c", "q")], "ws string, pos int, id string, dir_name string")
    both = workspace.add_entries(kept, more)
    assert sorted((r.ws, r.pos, r.id) for r in both.collect()) == [("v", 0, "c"), ("w", 0, "a"), ("w", 1, "c")]
    assert workspace.remove_entries(both, spark.createDataFrame([("w", "a")], "ws string, id string")).count() == 2
    for bad in ("", "..", "a/b", "a\\b", "c:x", " a", ".hidden"):
        with pytest.raises(ValueError):
            workspace.validate_name(bad)
    assert workspace.validate_name("my-review 2") == "my-review 2"


def test_figures(spark):
    plan = spark.createDataFrame([("w", "# P\n## Figures\n| Figure | Title |\n|---|---|\n| F1 | one |\n| F2 | two |\n## Other\n| F9 | x |")], "ws string, text string")
    planned = workspace.planned_figures(plan).where("figure rlike '^F[0-9]'")
    assert sorted(r.figure for r in planned.collect()) == ["F1", "F2"]
    manifest = spark.createDataFrame([("F1", "/f1.png"), ("F2", "/f2.png")], "figure string, path string")
    files = spark.createDataFrame([("/f1.png",)], "path string")
    assert {r.figure: r.status for r in workspace.figure_status(planned, manifest, files).collect()} == {"F1": "complete", "F2": "file_missing"}


def test_exchange_files(spark, tmp_path):
    (tmp_path / "a.ris").write_text("TY  - JOUR\nTI  - A title\nAU  - Smith, John\nAU  - Doe, Jane\nPY  - 2021/03\nJO  - J\nDO  - https://doi.org/10.1/X\nSP  - 1\nEP  - 9\nER  - \nTY  - BOOK\nT1  - B\nER  - \n")
    got = sorted(library.ris_records(spark, f"file://{tmp_path}/a.ris").collect(), key=lambda r: r.title)
    assert [(r.paper_type, r.title, r.authors, r.year, r.doi, r.pages) for r in got] == [("journal-article", "A title", ["John Smith", "Jane Doe"], 2021, "10.1/x", "1-9"), ("book", "B", [], None, "", "")]
    (tmp_path / "f.xml").write_text("<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A\n title</title><summary> S </summary><published>2024-01-01T00:00:00Z</published><author><name>N One</name></author></entry></feed>")
    (row,) = library.feed(spark, f"file://{tmp_path}/f.xml").collect()
    assert (row.arxiv_id, row.title, row.abstract, row.year, row.authors) == ("2401.00001", "A title", "S", 2024, ["N One"])
    (tmp_path / "w.jsonl").write_text(json.dumps({"id": "https://x/W1", "doi": "https://doi.org/10.2/Y", "title": "<i>T</i> x", "publication_year": 2020, "cited_by_count": 3, "abstract_inverted_index": {"b": [1], "a": [0, 2]}}) + "\n\n")
    (row,) = library.works(spark, f"file://{tmp_path}/w.jsonl").collect()
    assert (row.work_id, row.doi, row.title, row.abstract) == ("W1", "10.2/y", "T x", "a b a")
    assert library.works_filter(issn="1234-5678", years="2020-2022", min_citations=0) == "primary_location.source.issn:1234-5678,publication_year:2020-2022"


def test_entity_attribute_values(spark):
    f = spark.createDataFrame
    got = library.items_from_eav(
        f([(1, "article"), (2, "book")], "item_id int, kind string"), f([(1, 1, 1), (1, 2, 2), (2, 1, 3)], "item_id int, field_id int, value_id int"),
        f([(1, "T"), (2, "2020"), (3, "Gone")], "value_id int, value string"), f([(1, "title"), (2, "date")], "field_id int, field_name string"),
        f([(1, 1, "B", "Two"), (1, 0, "A", "One")], "item_id int, order_index int, first_name string, last_name string"), f([(2,)], "item_id int"), ["title", "date"],
    ).collect()
    assert [(r.item_id, r.title, r.date, r.authors) for r in got] == [(1, "T", "2020", ["A One", "B Two"])]
    counts = library.collections_with_counts(f([(1, "b"), (2, "a")], "collection_id int, name string"), f([(1, 5)], "collection_id int, item_id int")).collect()
    assert [(r.name, r.n_items) for r in counts] == [("a", 0), ("b", 1)]
    files = f([(1, "/suppl.pdf", 99), (1, "/main.pdf", 5), (2, "/x_si_1.pdf", 1)], "id int, path string, size int")
    assert {r.id: r.path for r in library.main_file(files).collect()} == {1: "/main.pdf", 2: "/x_si_1.pdf"}


def test_of_lines_with_the_same_part_the_greatest_supplier_counts(spark, tmp_path):
    from sparquill.plans.more_queries import eav_records

    rows = [(1, 1, 5, 9), (1, 1, 5, 12), (1, 1, 5, 10), (2, 2, 10, 3), (2, 2, 9, 4), (7, 1, 1, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, eav_records(spark, f"file://{tmp_path}").collect()))
    assert got == [(1, "5", None, "12"), (2, None, "10", "3")]


def test_text_functions(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x

    assert one(X.normalize_doi("t"), " DOI: https://doi.org/10.1/AbC ") == "10.1/abc"
    assert one(X.normalize_pmid("t"), "https://pubmed.ncbi.nlm.nih.gov/123/") == "123" and one(X.normalize_pmid("t"), "12a") == ""
    assert one(X.slug("t"), " Größe & Maß! ") == "größe-maß"
    assert one(X.strip_inline("t"), "**b** *i* `c` [l](u)") == "b i c l"
    assert one(X.strip_images("t"), "a ![x](y) b<img src=1>") == "a  b"
    assert one(X.clean_null_words("t"), " N/A ") == "" and one(X.year_of("t"), "May 2019") == 2019
    assert one(X.citekeys("t"), "see [@a1; @b_2]. x@y.z (@c:3).") == ["a1", "b_2", "c:3"]
    found = one(X.citations("t"), "Smith et al. (2020) and Doe (2019) say (Smith et al., 2020; Lee & Kim, 2018).")
    assert [(c.author, c.year) for c in found] == [("Smith et al.", "2020"), ("Doe", "2019"), ("Lee & Kim", "2018")]
    assert one(X.surname("t"), "Lee & Kim") == "Lee" and one(X.flip_name("t"), "Doe, Jane") == "Jane Doe"
    assert one(X.similar_titles("t", F.lit("A study of x")), "a study of  X") is True
    assert one(X.limitations("t"), "It works. However, it is slow! Done.") == ["However, it is slow!"]


def test_text_rules_of_the_record(spark):
    """Literal cases, empty and multi-line texts among them."""

    def one(column, value):
        return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x

    for t in ("The ABSTRACT is not available here", "A preview has been provided", "see the Access Link"):
        assert one(X.is_boilerplate("t"), t) is True
    for t in ("", None, "No abstract", "© 2020", "Abstract not available", "Click to increase image size"):
        assert one(X.is_boilerplate("t"), t) is False
    assert one(X.slug("t"), "") == one(X.slug("t"), None) == one(X.slug("t"), " -- ") == "section"
    assert one(X.slug("t"), "方法 与 Results_1") == "方法-与-results_1"
    assert one(X.run_name("t"), " T cells. v2/β 肿瘤 ") == "t-cells-v2-肿瘤" and one(X.run_name("t"), "...") == "query"
    assert one(X.run_name("t"), "a" * 60) == "a" * 48
    assert one(X.sentences("t"), "One\n line.  Two\tlines!\n\nThree") == ["One line.", "Two lines!", "Three"]
    assert one(X.sentences("t"), " \n ") == [] == one(X.sentences("t"), None)
    long = "However " + "x" * 600
    assert one(X.limitations("t"), f"{long}. HOWEVER so. However so. however\nso.") == [long[:500], "HOWEVER so."]
    assert len(one(X.limitations("t"), " ".join(f"However {i}." for i in range(20)))) == 5
    assert len(one(X.quantitative_signals("t"), " ".join(f"We saw {i} mice." for i in range(20)))) == 8


def test_types_without_a_conclusion(spark):
    from sparquill.operators import cards as C

    types = ["thesis", "dissertation", "book", "monograph", "edited-book", "reference-book", "book-chapter", "book-section", "book-part", "document", "technical-report", "lecture-notes", "patent"]
    rows = [(i, f"## Conclusion\n{'This holds. ' * 20}", t) for i, t in enumerate([*types, " Book ", "article", None])]
    got = {r.d: r.status for r in C.cards(spark.createDataFrame(rows, "d int, t string, k string"), "d", "t", "k").collect()}
    assert [got[i] for i in range(len(rows))] == ["skipped"] * 14 + ["ok"] * 2


def test_a_reference_list_is_numbered_over_ranges(spark):
    """Positions over several ranges, with ties, nulls and a row that makes up a third of all."""
    rows = [(str(i % 40), f"T{i % 7}" if i % 5 else None, 1990 + i % 9 if i % 4 else None) for i in range(120)] + [("hot", "Same", 2000)] * 60
    df = spark.createDataFrame([(i, t, [], y, *[None] * 6) for i, t, y in rows], "id string, title string, authors array<string>, year int, journal string, doi string, volume string, issue string, pages string, paper_type string")
    lines = exports.reference_list(df, "apa", numbered=True)
    got = [(r.position, r.line) for r in lines.collect()]
    assert sorted(p for p, _ in got) == list(range(1, 181))
    plain = exports.formatted(df, "apa").select("year", "title", "id", "reference").collect()
    want = sorted(plain, key=lambda r: (-(r.year or 0), r.title is not None, r.title or "", r.id, r.reference))
    assert [x for _, x in sorted(got)] == [f"{i}. {r.reference}" for i, r in enumerate(want, 1)]
    assert "SinglePartition" not in lines._jdf.queryExecution().toString()
    assert exports.reference_list(df.limit(0), "apa").count() == 0
