"""Bibliographic exports as Column expressions over records.

A record has title, authors (array), first_author_lastname, year (int), journal,
volume, issue, pages, publisher, issn, doi, abstract and paper_type; missing ones
are null or empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.session import stored

# Entry types.
BIBTEX_TYPES = {
    "journal-article": "article", "review": "article", "book-chapter": "inbook", "book": "book",
    "proceedings-article": "inproceedings", "conference-paper": "inproceedings", "thesis": "phdthesis",
    "dissertation": "phdthesis", "preprint": "misc", "document": "misc", "technical-report": "techreport",
    "manual": "manual", "lecture-notes": "misc", "standard": "misc", "white-paper": "misc",
    "presentation": "misc", "meeting-notes": "misc",
}
RIS_TYPES = {
    "journal-article": "JOUR", "review": "JOUR", "book-chapter": "CHAP", "book": "BOOK",
    "proceedings-article": "CONF", "conference-paper": "CONF", "thesis": "THES", "dissertation": "THES",
    "preprint": "UNPB", "document": "GEN", "technical-report": "RPRT", "manual": "MANSCPT",
    "lecture-notes": "GEN", "standard": "STAND", "white-paper": "RPRT", "presentation": "SLIDE",
    "meeting-notes": "GEN",
}


def _map(kinds: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.coalesce("paper_type", F.lit(""))), F.lit(default))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _authors() -> Column:
    return F.coalesce("authors", F.array().cast("array<string>"))


def _if(name: str, *parts: Column | str) -> Column:
    """The parts concatenated if the column has a value, else null."""
    return F.when(_text(name) != "", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def bibtex_escape(c: Column) -> Column:
    return F.regexp_replace(c, "([&%#_])", "\\\\$1")


def cite_key() -> Column:
    """Surname, year and the title's first word of more than three letters, letters only."""
    last = F.regexp_replace(F.coalesce(F.nullif("first_author_lastname", F.lit("")), F.lit("Unknown")), "[^a-zA-Z]", "")
    words = F.filter(F.transform(F.split(F.trim(_text("title")), "\\s+"), lambda w: F.regexp_replace(w, "[^a-zA-Z]", "")), lambda w: F.length(w) > 3)
    word = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))
    return F.concat(last, _text("year"), F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, 1000)))


def bibtex() -> Column:
    """One entry."""
    e = bibtex_escape
    field = lambda c, name, value: F.when(_text(c) != "", F.concat(F.lit(f"  {name} = {{"), value, F.lit("},")))
    authors = F.when(F.size(_authors()) > 0, F.concat(F.lit("  author = {"), e(F.array_join(_authors(), " and ")), F.lit("},")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("@"), _map(BIBTEX_TYPES, "article"), F.lit("{"), cite_key(), F.lit(",")),
        field("title", "title", F.concat(F.lit("{"), e(_text("title")), F.lit("}"))),
        authors,
        field("year", "year", _text("year")),
        field("journal", "journal", e(_text("journal"))),
        field("volume", "volume", _text("volume")),
        field("issue", "number", _text("issue")),
        field("pages", "pages", _text("pages")),
        field("publisher", "publisher", e(_text("publisher"))),
        field("issn", "issn", _text("issn")),
        field("doi", "doi", _text("doi")),
        field("abstract", "abstract", F.concat(F.lit("{"), e(_text("abstract")), F.lit("}"))),
        F.lit("}"),
    )


def ris() -> Column:
    """One entry, from TY to ER."""
    pages, dash = _text("pages"), F.instr(_text("pages"), "-")
    first = F.when(dash > 0, F.trim(F.expr("substring(cast(pages as string), 1, instr(cast(pages as string), '-') - 1)"))).otherwise(pages)
    last = F.when(dash > 0, F.concat(F.lit("EP  - "), F.trim(F.expr("substring(cast(pages as string), instr(cast(pages as string), '-') + 1)"))))
    authors = F.when(F.size(_authors()) > 0, F.array_join(F.transform(_authors(), lambda a: F.concat(F.lit("AU  - "), a)), "\n"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("TY  - "), _map(RIS_TYPES, "GEN")),
        _if("title", "TI  - ", _text("title")),
        authors,
        _if("year", "PY  - ", _text("year")),
        _if("journal", "JO  - ", _text("journal")),
        _if("volume", "VL  - ", _text("volume")),
        _if("issue", "IS  - ", _text("issue")),
        _if("pages", "SP  - ", first),
        last,
        _if("publisher", "PB  - ", _text("publisher")),
        _if("issn", "SN  - ", _text("issn")),
        _if("doi", "DO  - ", _text("doi"), "\nUR  - https://doi.org/", _text("doi")),
        _if("abstract", "AB  - ", _text("abstract")),
        F.lit("ER  -"),
    )


# --- citation styles


def _given(a: Column) -> Column:
    return F.trim(F.regexp_extract(a, "(?s)^[^,]*,(.*)$", 1))


def _family(a: Column) -> Column:
    return F.trim(F.regexp_extract(a, "(?s)^([^,]*),", 1))


def _last_first(a: Column) -> Column:
    return F.when(a.contains(","), F.concat(_family(a), F.lit(", "), _given(a))).otherwise(a)


def _first_last(a: Column) -> Column:
    return F.when(a.contains(","), F.concat(_given(a), F.lit(" "), _family(a))).otherwise(a)


def _initials(a: Column) -> Column:
    letters = F.array_join(F.transform(F.filter(F.split(_given(a), "\\s+"), lambda w: w != ""), lambda w: F.left(w, F.lit(1))), "")
    return F.when(a.contains(","), F.concat(_family(a), F.lit(" "), letters)).otherwise(a)


def _at(a: Column, i: int) -> Column:
    return F.try_element_at(a, F.lit(i))


def _or(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(_text(name), F.lit("")), F.lit(default))


def _opt(name: str, before: str, after: str = "") -> Column:
    return F.coalesce(_if(name, before, _text(name), after), F.lit(""))


def _doi(before: str) -> Column:
    return _opt("doi", before)


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, "\\.+$", "")


def apa() -> Column:
    a, n = _authors(), F.size(_authors())
    most = F.concat(F.array_join(F.slice(a, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", & "), _at(a, -1))
    names = F.when(n == 0, "Unknown").when(n == 1, _at(a, 1)).when(n <= 3, most).otherwise(F.concat(_at(a, 1), F.lit(" et al.")))
    volume = F.coalesce(_if("volume", ", *", _text("volume"), "*", _opt("issue", "(", ")")), F.lit(""))
    journal = F.coalesce(_if("journal", " *", _text("journal"), "*", volume, _opt("pages", ", "), "."), F.lit(""))
    return F.concat(names, F.lit(" ("), _or("year", "n.d."), F.lit("). "), _or("title", "Untitled"), F.lit("."), journal, _doi(" https://doi.org/"))


def vancouver() -> Column:
    short, n = F.transform(_authors(), _initials), F.size(_authors())
    names = F.when(n == 0, "Unknown").when(n <= 6, F.array_join(short, ", ")).otherwise(F.concat(F.array_join(F.slice(short, 1, 6), ", "), F.lit(", et al")))
    ref = F.concat(names, F.lit(". "), _or("title", "Untitled"), F.lit("."), _opt("journal", " ", "."), F.lit(" "), _or("year", "n.d."), _opt("volume", ";"), _opt("issue", "(", ")"), _opt("pages", ":"))
    return F.concat(F.regexp_replace(ref, "[;:]+$", ""), F.lit("."), _doi(" doi:"))


def chicago() -> Column:
    a, n = _authors(), F.size(_authors())
    lead = _last_first(_at(a, 1))
    others = F.transform(F.slice(a, 2, F.greatest(n - 2, F.lit(0))), _first_last)
    few = F.concat(F.array_join(F.concat(F.array(lead), others), ", "), F.lit(", and "), _first_last(_at(a, -1)))
    names = F.when(n == 0, "Unknown").when(n == 1, lead).when(n <= 3, few).otherwise(F.concat(_bare(lead), F.lit(" et al.")))
    ref = F.concat(_bare(names), F.lit(". "), _or("year", "n.d."), F.lit('. "'), _or("title", "Untitled"), F.lit('."'), _opt("journal", " *", "*"), _opt("volume", " "), _opt("issue", " (", ")"), _opt("pages", ": "))
    return F.concat(F.regexp_replace(ref, ":+$", ""), F.lit("."), _doi(" https://doi.org/"))


def mla() -> Column:
    a, n = _authors(), F.size(_authors())
    lead = _last_first(_at(a, 1))
    names = F.when(n == 0, "Unknown").when(n == 1, lead).when(n == 2, F.concat(lead, F.lit(", and "), _first_last(_at(a, 2)))).otherwise(F.concat(_bare(lead), F.lit(", et al.")))
    ref = F.concat(_bare(names), F.lit('. "'), _or("title", "Untitled"), F.lit('."'), _opt("journal", " *", "*"), _opt("volume", ", vol. "), _opt("issue", ", no. "), F.lit(", "), _or("year", "n.d."), _opt("pages", ", pp. "))
    return F.concat(F.regexp_replace(ref, ",+$", ""), F.lit("."), _doi(" https://doi.org/"))


STYLES: dict[str, Callable[[], Column]] = {"apa": apa, "vancouver": vancouver, "chicago-author-date": chicago, "mla": mla}
_CUSTOM: dict[str, Callable[[dict], str]] = {}


def register_style(name: str, format_record: Callable[[dict], str]) -> None:
    """Add a style in Python; it runs over batches of records. Names are words and dashes; built-in ones stay."""
    if not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", name) or name in STYLES:
        raise ValueError(f"not a free style name: {name!r}")
    _CUSTOM[name] = format_record


def styles() -> list[str]:
    return sorted([*STYLES, *_CUSTOM])


def formatted(records: DataFrame, style: str = "apa", column: str = "reference") -> DataFrame:
    """records with a column of formatted references."""
    if style in STYLES:
        return records.withColumn(column, STYLES[style]())
    if style not in _CUSTOM:
        raise ValueError(f"no style {style!r}; there are {', '.join(styles())}")
    one = _CUSTOM[style]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([one(r) for r in b.to_dict("records")], dtype="object")

    apply = F.pandas_udf(run, "string")
    return records.withColumn(column, apply(F.struct(*records.columns)))


def reference_list(records: DataFrame, style: str = "apa", numbered: bool = False, key: str = "id") -> DataFrame:
    """(position, line): newest first, then by title, key and reference; null years count as 0.

    Rows are dealt by ranges of that order and numbered within each; what comes before a range
    is the sum of the earlier counts, of which there is one a range. Rows that are equal in all
    of it travel as one with a count.
    """
    narrow = formatted(records, style).select(F.coalesce(F.col("year"), F.lit(0)).alias("year"), "title", F.col(key).alias("key"), "reference")
    equal = narrow.groupBy("year", "title", "key", "reference").agg(F.count("*").alias("times"))
    order = [F.desc("year"), "title", "key", "reference"]
    ranges = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that ranges stay as they are however often a task runs
    dealt = stored(equal.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "reference-list")
    before, starts = 0, []
    for r in dealt.groupBy("part").agg(F.sum("times").alias("n")).orderBy("part").collect():  # a row per range
        starts.append((r.part, before))
        before += r.n
    offsets = F.broadcast(records.sparkSession.createDataFrame(starts, "part int, before long"))
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ended = dealt.join(offsets, "part").withColumn("end", F.col("before") + F.sum("times").over(w))
    placed = ended.select(F.explode(F.sequence(F.col("end") - F.col("times") + 1, F.col("end"))).alias("position"), "reference").withColumn("position", F.col("position").cast("int"))
    mark = F.concat(F.col("position").cast("string"), F.lit(". ")) if numbered else F.lit("- ")
    return placed.select("position", F.concat(mark, F.col("reference")).alias("line"))


def select_records(records: DataFrame, years: str | None = None, journal: str | None = None, paper_type: str | None = None) -> DataFrame:
    """What an export asks for: a missing year fails every bound; names by literal substring."""
    from sparquill.functions.dates import export_year_filter

    if years:
        records = records.where(export_year_filter(F.col("year"), years))
    for column, part in (("journal", journal), ("paper_type", paper_type)):
        if part:
            records = records.where(F.contains(F.lower(X.text_or_empty(column)), F.lit(part.lower())))
    return records


def metadata_rows(records: DataFrame) -> DataFrame:
    """Flat rows for CSV: authors joined by `; `."""
    return records.select("id", "title", F.array_join(_authors(), "; ").alias("authors"), "year", "journal", "doi", "paper_type")
