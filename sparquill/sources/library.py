"""Reading a library: record files, full texts, silos, lists, exchange formats.

All are Spark readers with an explicit schema; nothing infers one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions import text as X

PAPER = (
    "id string, title string, authors array<string>, first_author string, first_author_lastname string, year int, "
    "journal string, doi string, pmid string, abstract string, paper_type string, citation_count map<string,bigint>, "
    "ids map<string,string>, volume string, issue string, pages string, publisher string, issn string, "
    "references array<string>, toc array<struct<line:int,level:int,title:string>>, "
    "l3 struct<takeaway:string,confidence:string,mode:string,key_findings:array<string>,limitations:array<string>>"
)


def _dir_name(column: str = "_metadata.file_path") -> Column:
    return F.element_at(F.split(F.url_decode(F.col(column)), "/"), -2)


def records(spark: SparkSession, root: str) -> DataFrame:
    """One row per `<dir>/meta.json`, with dir_name; a file that isn't JSON has corrupt = true."""
    schema = PAPER + ", _corrupt_record string"
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").json(root)
    kept = df.select("*", _dir_name().alias("dir_name"))
    return kept.withColumn("corrupt", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def full_texts(spark: SparkSession, root: str) -> DataFrame:
    """(dir_name, markdown) of `<dir>/paper.md`; bytes that aren't UTF-8 are replaced."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "paper.md").load(root)
    return df.select(F.element_at(F.split(F.url_decode("path"), "/"), -2).alias("dir_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("markdown"))


def papers(spark: SparkSession, root: str) -> DataFrame:
    """Records with their full text where there is one."""
    return records(spark, root).join(full_texts(spark, root), "dir_name", "left")


def layer1(papers: DataFrame) -> DataFrame:
    """Metadata with defaults; the directory's name stands in for a missing id."""
    none = F.array().cast("array<string>")
    return papers.select(
        F.coalesce(F.nullif("id", F.lit("")), "dir_name").alias("paper_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("authors", none).alias("authors"),
        "year",
        F.coalesce("journal", F.lit("")).alias("journal"),
        F.coalesce("doi", F.lit("")).alias("doi"),
        best_citation("citation_count").alias("citations"),
    )


def layer2(papers: DataFrame) -> DataFrame:
    return papers.select("dir_name", F.coalesce(F.nullif(F.trim("abstract"), F.lit("")), F.lit("[No abstract available]")).alias("abstract"))


def layer3(papers: DataFrame) -> DataFrame:
    """The conclusion card as text for the index: takeaway, confidence, mode, then the items."""
    items = F.concat(F.coalesce("l3.key_findings", F.array().cast("array<string>")), F.coalesce("l3.limitations", F.array().cast("array<string>")))
    head = F.array_compact(F.array(F.nullif("l3.takeaway", F.lit("")), F.nullif("l3.confidence", F.lit("")), F.nullif("l3.mode", F.lit(""))))
    return papers.select("dir_name", F.array_join(F.concat(head, items), "\n").alias("card"))


def layer4(papers: DataFrame) -> DataFrame:
    return papers.select("dir_name", "markdown")


def best_citation(column: str) -> Column:
    """The largest of the sources' counts, 0 without any."""
    return F.coalesce(F.array_max(F.map_values(F.col(column))), F.lit(0))


def metadata_node(title: str = "title", authors: str = "authors", journal: str = "journal", year: str = "year") -> Column:
    """`Label: value` lines, blank ones left out."""
    line = lambda label, c: F.when(F.trim(X.text_or_empty(c)) != "", F.concat(F.lit(f"{label}: "), X.text_or_empty(c)))
    return F.concat_ws("\n", line("Title", title), line("Authors", authors), line("Journal", journal), line("Year", year))


def silo(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def works(spark: SparkSession, path: str) -> DataFrame:
    """Saved works of a bibliographic service: titles without markup, abstracts from their inverted index."""
    schema = "id string, doi string, title string, publication_year int, cited_by_count bigint, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>"
    df = spark.read.schema(schema).json(path)
    abstract = X.inverted_to_text("abstract_inverted_index")
    return df.select(
        F.regexp_extract("id", "([^/]+)$", 1).alias("work_id"),
        X.normalize_doi("doi").alias("doi"),
        X.strip_tags("title").alias("title"),
        F.col("publication_year").alias("year"),
        F.col("cited_by_count").alias("cited"),
        F.when(X.is_boilerplate(abstract), "").otherwise(abstract).alias("abstract"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"),
    )


# The service's fields, in the order in which they are asked for.
FILTER_FIELDS = {
    "issn": "primary_location.source.issn",
    "concept": "concepts.id",
    "topic": "topics.id",
    "author": "authorships.author.id",
    "institution": "authorships.institutions.id",
    "source_type": "primary_location.source.type",
    "years": "publication_year",
    "min_citations": "cited_by_count",
    "work_type": "type",
}


def works_filter(*, min_citations: int | None = None, **wanted: str | None) -> str:
    """The service's filter string of the FILTER_FIELDS given; a count that isn't positive is left out.

    Keywords are no filter: the service takes them as a search parameter of their own.
    """
    if unknown := set(wanted) - set(FILTER_FIELDS):
        raise TypeError(f"no such filters: {sorted(unknown)}")
    values = wanted | {"min_citations": f">{min_citations - 1}" if (min_citations or 0) > 0 else None}
    return ",".join(f"{field}:{values[name]}" for name, field in FILTER_FIELDS.items() if values.get(name))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a saved Atom feed; entries that aren't well formed are dropped."""
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>, doi string"
    df = spark.read.format("xml").schema(schema).option("rowTag", "entry").option("ignoreNamespace", True).option("mode", "DROPMALFORMED").load(path)
    return df.select(
        F.regexp_extract("id", "abs/([^v]+)(?:v\\d+)?$", 1).alias("arxiv_id"),
        F.trim(F.regexp_replace("title", "\\s+", " ")).alias("title"),
        F.trim(F.regexp_replace("summary", "\\s+", " ")).alias("abstract"),
        X.year_of("published").alias("year"),
        F.transform("author", lambda a: a["name"]).alias("authors"),
        X.normalize_doi("doi").alias("doi"),
    )


# Names of record types in exchange files.
RIS_KINDS = {"JOUR": "journal-article", "CHAP": "book-chapter", "BOOK": "book", "CONF": "conference-paper", "THES": "thesis", "UNPB": "preprint", "RPRT": "technical-report", "GEN": "document"}


def ris_records(spark: SparkSession, path: str) -> DataFrame:
    """RIS files: records end with `ER  -`; `Last, First` names are flipped."""
    raw = spark.read.option("lineSep", "ER  -").text(path).where(F.col("value").rlike("TY  - "))
    one = lambda tag: F.trim(F.regexp_extract("value", f"(?m)^{tag}  - (.*)$", 1))
    many = lambda tag: F.transform(F.regexp_extract_all("value", F.lit(f"(?m)^{tag}  - (.*)$"), F.lit(1)), lambda x: F.trim(x))
    first = lambda *tags: F.coalesce(*[F.nullif(one(t), F.lit("")) for t in tags], F.lit(""))
    kinds = F.create_map(*[F.lit(x) for kv in RIS_KINDS.items() for x in kv])
    return raw.select(
        F.coalesce(F.try_element_at(kinds, one("TY")), F.lit("document")).alias("paper_type"),
        first("TI", "T1").alias("title"),
        F.transform(F.concat(many("AU"), many("A1")), X.flip_name).alias("authors"),
        X.year_of(first("PY", "Y1", "DA")).alias("year"),
        first("JO", "JF", "T2", "JA").alias("journal"),
        X.normalize_doi(one("DO")).alias("doi"),
        first("VL").alias("volume"),
        first("IS").alias("issue"),
        F.concat_ws("-", F.nullif(one("SP"), F.lit("")), F.nullif(one("EP"), F.lit(""))).alias("pages"),
        first("AB", "N2").alias("abstract"),
        many("L1").alias("files"),
    )


def xml_records(spark: SparkSession, path: str) -> DataFrame:
    """Reference-manager XML: one row per <record>."""
    style = "struct<style:string>"
    schema = f"`ref-type` struct<_name:string>, titles struct<title:{style},`secondary-title`:{style}>, contributors struct<authors:struct<author:array<{style}>>>, dates struct<year:{style}>, `electronic-resource-num` {style}, abstract {style}, urls struct<`pdf-urls`:struct<url:array<string>>>"
    df = spark.read.format("xml").schema(schema).option("rowTag", "record").load(path)
    return df.select(
        F.col("`ref-type`._name").alias("kind"),
        F.trim("titles.title.style").alias("title"),
        F.trim("titles.`secondary-title`.style").alias("journal"),
        F.transform("contributors.authors.author", lambda a: X.flip_name(a["style"])).alias("authors"),
        X.year_of("dates.year.style").alias("year"),
        X.normalize_doi("`electronic-resource-num`.style").alias("doi"),
        F.col("abstract.style").alias("abstract"),
        F.col("urls.`pdf-urls`.url").alias("files"),
    )


def main_file(files: DataFrame, key: str = "id") -> DataFrame:
    """Of a record's files (key, path, size) the largest that isn't a supplement; the largest of all if only those are there."""
    extra = F.lower("path").rlike("suppl|supporting|appendix|_si[_.]|esm")
    return files.groupBy(key).agg(F.max_by("path", F.struct(~extra, "size", "path")).alias("path"))


def items_from_eav(items: DataFrame, data: DataFrame, values: DataFrame, fields: DataFrame, creators: DataFrame, deleted: DataFrame, wanted: list[str]) -> DataFrame:
    """Entity-attribute-value tables of a reference manager to records; deleted items go, creators keep their order."""
    live = items.join(deleted.select("item_id"), "item_id", "left_anti")
    named = data.join(values, "value_id").join(fields.where(F.col("field_name").isin(*wanted)), "field_id")
    wide = named.groupBy("item_id").pivot("field_name", wanted).agg(F.min("value"))
    who = creators.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "first_name", "last_name"))), lambda c: F.trim(F.concat_ws(" ", c["first_name"], c["last_name"]))).alias("authors"))
    return live.join(wide, "item_id", "left").join(who, "item_id", "left")


def collections_with_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Collections with the number of their items, none included, by name."""
    return collections.join(members, "collection_id", "left").groupBy("collection_id", "name").agg(F.count("item_id").alias("n_items")).orderBy("name", "collection_id")


def workspaces(spark: SparkSession, root: str) -> DataFrame:
    """(ws, pos, id, dir_name, added_at) of `<ws>/papers.json` lists; rows without id go."""
    df = spark.read.schema("id string, dir_name string, added_at string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "papers.json").json(root)
    kept = df.select(_dir_name().alias("ws"), F.monotonically_increasing_id().alias("pos"), "id", "dir_name", "added_at")
    return kept.where(F.col("id").isNotNull())
