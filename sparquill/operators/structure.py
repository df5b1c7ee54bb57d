"""Headings of long texts from Markdown, plain lines and layout files, merged; where the body starts; a table of contents.

Headings are rows (key, line from 1, level 1 to 3, title, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import headings as H

# Names of sections, forms of numbers before them, lengths.
SECTIONS = (
    "abstract", "background", "introduction", "materials and methods", "methods", "method", "results", "results and discussion", "discussion",
    "discussion and conclusion", "discussion and conclusions", "conclusion", "conclusions", "concluding remarks", "summary", "summary and outlook", "outlook",
    "references", "bibliography", "acknowledgments", "acknowledgements", "funding", "appendix", "supplementary information", "supplementary material",
    "data availability", "author contributions", "conflict of interest", "declaration of competing interest",
    "preface", "foreword", "index", "glossary", "nomenclature", "notation",
)
SECTIONS_ZH = ("摘要", "引言", "前言", "绪论", "方法", "材料与方法", "结果", "讨论", "结论", "总结", "结语", "小结", "讨论与结论", "结论与展望", "总结与展望", "参考文献", "致谢", "附录")
FRONT = ("preface", "foreword", "notation", "symbol", "acknowledgment", "acknowledgement")
FRONT_ZH = ("摘要", "前言", "序言", "绪论")
NUMBERED = "^(\\d+(?:[.．]\\d+)*)[.．]?(?:\\s+|(?=[A-Za-z\\u4e00-\\u9fff]))"
NUMBER = "^(\\d+(?:[.．]\\d+)*)[.．]?\\s*"
CHAPTER = "(?i)^Chapter\\s+(\\d+)\\b"
CHAPTER_ZH = "^第\\s*([一二三四五六七八九十百\\d]+)\\s*章"
#: The first of these that fits is a title's prefix; the first two, NUMBERED and the last two mark a plain line as a heading.
PREFIX = "^(?:(?i:Chapter\\s+\\d+\\b)|第\\s*[一二三四五六七八九十百\\d]+\\s*章|\\d+(?:[.．]\\d+)*[.．]?\\s*|(?i:[IVXLCDM]+)[\\s.)]+|[A-Z][\\s.)]+)"
MARKED = "^(?:(?i:Chapter\\s+\\d+\\b)|第\\s*[一二三四五六七八九十百\\d]+\\s*章|\\d+(?:[.．]\\d+)*[.．]?(?:\\s|(?=[A-Za-z\\u4e00-\\u9fff]))|(?i:[IVXLCDM]+)[\\s.)]|[A-Z][\\s.)])"
TRAILING_PAGE = "[.\\s]\\s*\\d{2,4}\\s*$"
IMPRINT = "\\b(doi|copyright|received|accepted|published|correspondence|affiliation|license)\\b"
LONGEST, MOST_WORDS = 160, 24
LEAST_PAGES, FRONT_LINES, FRONT_SHARE = 5, 500, 0.10


def clean(title: Column) -> Column:
    """Without # before it, white space collapsed, no colons at the ends."""
    bare = F.regexp_replace(F.regexp_replace(title, "^\\s*#*\\s*|\\s+$", ""), "(?U)\\s+", " ")
    return F.regexp_replace(bare, "^[ :：]+|[ :：]+$", "")


def folded(title: Column) -> Column:
    """As H.folded_heading, for keys."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(title, "．", ".")), "(?U)[^\\w\\u4e00-\\u9fff]+", " "))


def _words(text: Column) -> Column:
    return F.size(F.split(F.trim(text), "\\s+"))


def _count(text: Column, signs: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{signs}]", ""))


def without_prefix(title: Column) -> Column:
    """The title behind its chapter, number, Roman numeral or letter."""
    return F.trim(F.regexp_replace(title, PREFIX, ""))


def is_known(title: Column) -> Column:
    bare = clean(without_prefix(title))
    low = F.regexp_replace(F.trim(F.split(F.lower(bare), ",")[0]), "[:：]+$", "")
    zh = F.regexp_replace(bare, "\\s+", "")
    return low.isin(*SECTIONS) | low.startswith("appendix") | low.startswith("supplementary") | zh.rlike("^(?:" + "|".join(SECTIONS_ZH) + ")")


def infer_level(title: Column) -> Column:
    """1.2.3 is at level 3, the deepest; what has no number, or nothing behind it, at 1."""
    depth = _count(F.regexp_extract(title, NUMBER, 1), ".．") + 1
    return F.when(title.rlike(NUMBER) & (without_prefix(title) != ""), F.least(depth, F.lit(3))).otherwise(1)


def _is_short(title: Column) -> Column:
    low = F.lower(title)
    return (title != "") & (F.length(title) <= LONGEST) & (_words(title) <= MOST_WORDS) & ~low.rlike("https?://") & ~title.contains("@")


def looks_plain(title: Column) -> Column:
    """Whether a cleaned line without mark reads like a heading: numbered, known, or in capitals."""
    tail = without_prefix(title)
    numbered = (tail != "") & ~((F.length(title) > 90) & (_count(tail, ".!?;") > 1))
    capitals = title.rlike("^[A-Z][A-Z0-9\\s/&()\\-]{2,80}$") & (_words(title) <= 12)
    fits = _is_short(title) & ~F.lower(title).rlike(IMPRINT) & (_count(title, ",;:!?。") <= 3)
    return fits & F.when(title.rlike(MARKED), numbered).otherwise(is_known(title) | capitals)


def plain_headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines without mark that read like headings."""
    s = H.lines(docs, key, text).select(key, "line", F.trim(F.regexp_replace("s", "^\\s+|\\s+$", "")).alias("s")).where((F.col("s") != "") & ~F.col("s").startswith("#"))
    short = s.withColumn("title", clean(F.col("s"))).where(F.length("title") <= LONGEST)  # most lines end here
    return short.where(looks_plain(F.col("title"))).select(key, "line", infer_level(F.col("s")).alias("level"), "title", F.lit("plaintext").alias("source"))


def placed_headings(docs: DataFrame, layout: DataFrame, key: str, text: str) -> DataFrame:
    """Headings of layout files (key, text, level), as extraction.layout_heading_rows gives them, at the lines of the text where they stand."""
    named = layout.select(key, clean(F.col("text")).alias("candidate"), F.col("level").cast("int").alias("level"))
    wanted = named.where(_is_short(F.col("candidate")) & (looks_plain(F.col("candidate")) | (F.col("level").isNotNull() & (_count(F.col("candidate"), ".!?;") <= 1))))
    one = wanted.groupBy(key, "candidate").agg(F.min("level").alias("level"))
    found = H.locate(docs, one, key, text, "candidate").join(one, [key, "candidate"])
    return found.select(key, "line", F.coalesce("level", infer_level(F.col("candidate"))).alias("level"), F.col("candidate").alias("title"), F.lit("layout").alias("source"))


def merged_headings(docs: DataFrame, key: str, text: str, layout: DataFrame | None = None) -> DataFrame:
    """All headings of a text, once per line and wording: Markdown's before a plain line's before a layout file's.

    Null and empty texts have none; null keys are kept as any other.
    """
    marked = H.markdown_headings(docs, key, text).withColumn("source", F.lit("markdown"))
    every = marked.unionByName(plain_headings(docs, key, text))
    if layout is not None:
        every = every.unionByName(placed_headings(docs, layout, key, text))
    rank = F.when(F.col("source") == "markdown", 0).when(F.col("source") == "plaintext", 1).otherwise(2)
    level = F.greatest(F.lit(1), F.least(F.col("level"), F.lit(3))).cast("int")
    titled = every.withColumn("title", clean(F.col("title"))).where("title <> ''")
    best = titled.groupBy(key, "line", folded(F.col("title")).alias("__f")).agg(F.min(F.struct(rank.alias("rank"), level.alias("level"), "title", "source")).alias("b"))
    return best.select(key, "line", "b.level", "b.title", "b.source")


def body(headings: DataFrame, key: str) -> DataFrame:
    """headings from where the body starts.

    Five or more headings with a page number among the first lines are a printed table of
    contents; behind its last one the body starts with the first chapter, section 1, or preface.
    Without such a mark it starts right behind, and if nothing is left all headings are kept.
    """
    whole = Window.partitionBy(key)
    title = F.col("title")
    low = F.lower(F.trim(title))
    front = F.regexp_replace(F.trim(F.split(low, " to ")[0]), "s+$", "").isin(*FRONT) | low.startswith("preface") | low.isin(*FRONT_ZH)
    starts = title.rlike(CHAPTER) | title.rlike(CHAPTER_ZH) | (F.split(F.regexp_extract(title, NUMBERED, 1), "\\.")[0] == "1") | front
    numbered = headings.withColumns({"__n": F.row_number().over(whole.orderBy("line", "level", low)), "__last": F.max("line").over(whole)})
    paged = title.rlike(TRAILING_PAGE) & (F.col("line") <= F.greatest(F.col("__last") * FRONT_SHARE, F.lit(float(FRONT_LINES))))
    behind = F.when(F.sum(paged.cast("int")).over(whole) >= LEAST_PAGES, F.max(F.when(paged, F.col("__n"))).over(whole) + 1).otherwise(1)
    cut = numbered.withColumns({"__behind": behind, "__starts": starts})
    first = F.min(F.when(F.col("__starts") & (F.col("__n") >= F.col("__behind")), F.col("__n"))).over(whole)
    kept = cut.withColumns({"__first": F.coalesce(first, F.col("__behind")), "__all": F.max("__n").over(whole)})
    return kept.where((F.col("__n") >= F.col("__first")) | (F.col("__first") > F.col("__all"))).select(*headings.columns)


def toc(headings: DataFrame, key: str, paper_title: Column | None = None) -> DataFrame:
    """(key, line, level, title) of the body's headings that make a table of contents.

    Those the body repeats three times or more, the paper's title and noise go; numbered ones,
    chapters and known sections stay.
    """
    low = F.lower(F.trim("title"))
    kept = body(headings, key).withColumn("__same", F.count("*").over(Window.partitionBy(key, low))).where((F.col("__same") < H.RUNNING) & ~low.isin(*H.NOISE))
    if paper_title is not None:
        kept = kept.where(~X.similar_titles("title", paper_title))
    t = F.col("title")
    number = F.regexp_extract(t, CHAPTER, 1)
    rest = F.trim(F.regexp_replace(t, CHAPTER, ""))
    chapter = F.when(rest != "", F.concat_ws(" ", number, rest)).otherwise(F.concat(F.lit("Chapter "), number))
    paged_off = F.regexp_replace(F.trim(F.regexp_replace(t, TRAILING_PAGE, "")), "\\.+$", "")
    depth = F.least(_count(F.regexp_extract(t, NUMBERED, 1), ".") + 1, F.lit(3))
    level = F.when(~t.rlike(CHAPTER) & ~t.rlike(CHAPTER_ZH) & t.rlike(NUMBERED), depth).otherwise(1)
    title = F.when(t.rlike(CHAPTER), chapter).when(~t.rlike(CHAPTER_ZH) & t.rlike(NUMBERED), paged_off).otherwise(t)
    wanted = t.rlike(CHAPTER) | t.rlike(CHAPTER_ZH) | t.rlike(NUMBERED) | is_known(t)
    return kept.where(wanted).select(key, "line", level.cast("int").alias("level"), title.alias("title"))
