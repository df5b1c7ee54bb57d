"""Text functions as Column expressions; all built-ins, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Blocks of characters indexed as two-grams.
CJK = "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\u3040-\\u30FF\\uAC00-\\uD7AF"
WORD = "[A-Za-z0-9_]+"


def _c(col: ColumnLike) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_or_empty(col: ColumnLike) -> Column:
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def ascii_tokens(col: ColumnLike) -> Column:
    """Distinct lower-cased ASCII words, in order of first occurrence."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty(col), F.lit(WORD), F.lit(0)), F.lower))


def _bigrams(run: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.when(F.length(run) > 1, pairs).otherwise(F.array(run))


def index_tokens(col: ColumnLike) -> Column:
    """ASCII words and two-grams of CJK runs, distinct, in order. White space doesn't end a run; anything else does."""
    t = text_or_empty(col)
    found = F.regexp_extract_all(t, F.lit(f"{WORD}|[{CJK}](?:\\s*[{CJK}])*"), F.lit(0))
    each = F.transform(found, lambda p: F.when(p.rlike("^[A-Za-z0-9_]"), F.array(F.lower(p))).otherwise(_bigrams(F.regexp_replace(p, "\\s+", ""))))
    # texts without such runs, most of them, take the short way
    return F.when(t.rlike(f"[{CJK}]"), F.array_distinct(F.flatten(each))).otherwise(ascii_tokens(t))


def index_terms(col: ColumnLike) -> Column:
    """index_tokens as the index holds them: split at underscores, so a term may repeat."""
    tokens = index_tokens(col)
    split = F.filter(F.flatten(F.transform(tokens, lambda t: F.split(t, "_"))), lambda t: t != "")
    return F.when(F.contains(text_or_empty(col), F.lit("_")), split).otherwise(tokens)


def folded_tokens(col: ColumnLike) -> Column:
    """Words of any script with accents folded, for silo search."""
    plain = F.regexp_replace(F.lower(text_or_empty(col)), "\\p{M}+", "")
    accents = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    return F.regexp_extract_all(F.translate(plain, accents, "aaaaaaceeeeiiiinooooouuuuyy"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def snippet(col: ColumnLike, terms: list[str], max_chars: int = 360) -> Column:
    """White space collapsed; a window of max_chars that starts a third of it ahead of the earliest term."""
    clean = F.trim(F.regexp_replace(text_or_empty(col), "\\s+", " "))
    low = F.lower(clean)
    n = F.length(clean)
    hits = [F.locate(t.lower(), low) for t in terms if t]
    first = reduce(lambda a, b: F.least(a, b), [F.when(h > 0, h - 1) for h in hits]) if len(hits) > 1 else (F.when(hits[0] > 0, hits[0] - 1) if hits else F.lit(None).cast("int"))
    start = F.greatest(F.lit(0), F.coalesce(first, F.lit(0)) - max_chars // 3)
    end = F.least(n, start + max_chars)
    start = F.greatest(F.lit(0), end - max_chars)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.trim(F.substring(clean, start + 1, end - start)), F.when(end < n, "...").otherwise(""))
    return F.when(n <= max_chars, clean).otherwise(cut)


def normalize_doi(col: ColumnLike) -> Column:
    """Prefix `doi:` and resolver address off, lower case."""
    t = F.trim(text_or_empty(col))
    t = F.trim(F.regexp_replace(t, "(?i)^doi:\\s*", ""))
    return F.lower(F.trim(F.regexp_replace(t, "(?i)^https?://(?:dx\\.)?doi\\.org/", "")))


def normalize_pmid(col: ColumnLike) -> Column:
    """Digits from an address, a `pmid:` prefix or plain; else empty."""
    t = F.trim(text_or_empty(col))
    in_url = F.regexp_extract(t, "(?i)pubmed\\.ncbi\\.nlm\\.nih\\.gov/(\\d+)", 1)
    bare = F.trim(F.regexp_replace(t, "(?i)^pmid:\\s*", ""))
    return F.when(in_url != "", in_url).when(bare.rlike("^[0-9]+$"), bare).otherwise("")


def normalize_title(col: ColumnLike) -> Column:
    return F.lower(F.trim(F.regexp_replace(text_or_empty(col), "\\s+", " ")))


def slug(col: ColumnLike) -> Column:
    """Lower case, runs of non-word characters to one dash, none at the ends; `section` if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(col)), "(?U)[^\\w]+", "-"), "^-+|-+$", "")
    return F.when(plain == "", "section").otherwise(plain)


def strip_tags(col: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(col), "<[^>]+>", ""))


def strip_images(col: ColumnLike) -> Column:
    """Markdown images, HTML images, and the blank lines they leave."""
    t = F.regexp_replace(text_or_empty(col), "!\\[[^\\]]*\\]\\([^)]*\\)", "")
    t = F.regexp_replace(t, "(?i)<img\\b[^>]*>", "")
    return F.regexp_replace(t, "\\n{3,}", "\n\n")


def strip_inline(col: ColumnLike) -> Column:
    """Inline Markdown to its text: links, bold, italics, code."""
    t = F.regexp_replace(text_or_empty(col), "!?\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    for pattern in ("\\*\\*\\*([^*]+)\\*\\*\\*", "\\*\\*([^*]+)\\*\\*", "\\*([^*]+)\\*", "__([^_]+)__", "`([^`]+)`"):
        t = F.regexp_replace(t, pattern, "$1")
    return t


def sentences(col: ColumnLike) -> Column:
    """White space collapsed, split after ., !, ? and their full-width forms where a space follows; blanks dropped."""
    plain = F.trim(F.regexp_replace(text_or_empty(col), "(?U)\\s+", " "))
    return F.filter(F.split(plain, "(?<=[.!?。！？]) "), lambda s: s != "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """Of the array's items with the same key the first, in order.

    Items are sorted by key and place and compared with their neighbours, so the cost
    grows as n log n; a list of keys searched for each item would grow as the square.
    """

    def firsts(placed: Column) -> Column:
        shifted = F.concat(F.array(F.lit(None).cast("string")), F.transform(placed, lambda x: x["k"]))
        marked = F.zip_with(placed, F.slice(shifted, 1, F.size(placed)), lambda x, before: F.when(before.isNull() | (before != x["k"]), F.struct(x["i"].alias("i"), x["e"].alias("e"))))
        return F.transform(F.array_sort(F.filter(marked, lambda x: x.isNotNull())), lambda x: x["e"])

    placed = lambda v: F.array_sort(F.transform(v, lambda e, i: F.struct(key(e).alias("k"), i.alias("i"), e.alias("e"))))
    return bound(items, lambda v: F.when(F.size(v) < 2, v).otherwise(bound(placed(v), firsts)))


def matching_sentences(col: ColumnLike, pattern: str, most: int, longest: int = 500) -> Column:
    """The first `most` sentences that match, cut to `longest` characters, of those that differ in case alone the first."""
    hits = F.transform(F.filter(sentences(col), lambda s: s.rlike(pattern)), lambda s: F.trim(F.substring(s, 1, longest)))
    return F.slice(first_of_each(hits, F.lower), 1, most)


# Patterns of sentences that measure something or limit a claim.
QUANTITY = (
    "(?i)(?:\\b\\d+(?:\\.\\d+)?\\s*(?:%|percent|fold|x|×|mg|µg|μg|ng|kg|ml|mL|days?|weeks?|months?|years?|hours?|h|nM|µM|μM|mm|cm|cells?|patients?|mice|samples?)\\b"
    "|\\bn\\s*=\\s*\\d+|p\\s*[<=>]\\s*0?\\.\\d+|95\\s*%\\s*CI|HR\\s*[=:]\\s*\\d|ORR|PFS|OS|CRS)"
)
LIMITATION = (
    "(?i)\\b(limitation|limited|however|although|caution|future|unclear|small sample|retrospective|prospective|not yet|further|warranted)\\b"
    "|(局限|不足|然而|未来|尚不|不能|仍需|有待|样本量)"
)


def quantitative_signals(col: ColumnLike, most: int = 8) -> Column:
    return matching_sentences(col, QUANTITY, most)


def limitations(col: ColumnLike, most: int = 5) -> Column:
    return matching_sentences(col, LIMITATION, most)


def head_and_tail(col: ColumnLike, most: int = 6000, share: float = 0.45, marker: str = "\n\n[...]\n\n") -> Column:
    """The text if short, else its first and last `share` of `most` characters."""
    t = text_or_empty(col)
    n = int(most * share)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(n)), F.lit(marker), F.right(t, F.lit(n))))


#: The longest substrings that texts are joined on before one is looked for in the other.
GRAM = 4


def grams(col: ColumnLike) -> Column:
    """The distinct substrings of 1 to GRAM characters of a text that isn't empty."""
    c = _c(col)
    lengths = lambda i: F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length(c) - i + 1))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(lengths(i), lambda n: c.substr(i, n)))))


def substrings(col: ColumnLike, lengths: ColumnLike) -> Column:
    """The distinct substrings of a text with one of the lengths of an array, each over 0."""
    c = _c(col)
    starts = lambda n: F.sequence(F.lit(1), F.length(c) - n + 1)
    fitting = F.filter(_c(lengths), lambda n: n <= F.length(c))
    return F.array_distinct(F.flatten(F.transform(fitting, lambda n: F.transform(starts(n), lambda i: c.substr(i, n)))))


def text_to_inverted(col: ColumnLike) -> Column:
    """map<word, array<position>> of the words between single blanks; inverted_to_text reads it back."""

    def ends(placed: Column) -> Column:
        # equal words stand together once sorted, by position
        numbered = F.transform(placed, lambda x, i: F.struct(x["w"].alias("w"), (i + 1).alias("end")))
        return F.filter(numbered, lambda x: (x["end"] == F.size(placed)) | (F.try_element_at(placed, x["end"] + 1)["w"] != x["w"]))

    def entries(placed: Column, v: Column) -> Column:
        start = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.try_element_at(v, i)["end"] + 1)
        return F.map_from_entries(F.transform(v, lambda x, i: F.struct(x["w"], F.transform(F.slice(placed, start(i), x["end"] - start(i) + 1), lambda p: p["p"]))))

    words = F.transform(F.split(_c(col), " "), lambda w, i: F.struct(w.alias("w"), i.alias("p")))
    return bound(F.sort_array(words), lambda placed: bound(ends(placed), lambda v: entries(placed, v)))


def inverted_to_text(col: ColumnLike) -> Column:
    """map<word, array<position>> to the text it indexes."""
    entries = F.map_entries(_c(col))
    placed = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " "), F.lit(""))


def short_hash(*cols: ColumnLike) -> Column:
    """First 12 hex digits of the md5 of the fields, one a line."""
    return F.substring(F.md5(F.concat_ws("\n", *[text_or_empty(c) for c in cols])), 1, 12)


def week_key(ts: ColumnLike) -> Column:
    """Year and week of Monday weeks, week 00 before the first Monday."""
    t = _c(ts)
    week = F.floor((F.dayofyear(t) - 1 + 7 - F.weekday(t)) / 7)
    return F.concat(F.date_format(t, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def clean_null_words(col: ColumnLike) -> Column:
    """Words that stand for nothing become empty."""
    t = F.trim(text_or_empty(col))
    return F.when(F.lower(t).isin("null", "none", "n/a"), "").otherwise(t)


def year_of(col: ColumnLike) -> Column:
    """The first four-digit year from 1000 to 2999, or null."""
    return F.expr("int(null)") if col is None else F.try_to_number(F.nullif(F.regexp_extract(text_or_empty(col), "\\b([12]\\d{3})\\b", 1), F.lit("")), F.lit("9999")).cast("int")


def flip_name(col: ColumnLike) -> Column:
    """`Last, First` to `First Last`; other forms as they are."""
    t = F.trim(text_or_empty(col))
    return F.when(t.contains(","), F.trim(F.concat_ws(" ", F.trim(F.regexp_extract(t, ",(.*)$", 1)), F.trim(F.regexp_extract(t, "^([^,]*),", 1))))).otherwise(t)


def run_name(col: ColumnLike, most: int = 48) -> Column:
    """A query as a name: ASCII letters, digits and CJK, dashes for the rest, at most `most` characters, lower case; `query` if nothing is left."""
    t = F.regexp_replace(F.trim(text_or_empty(col)), "[^A-Za-z0-9\\u3400-\\u9FFF]+", "-")
    plain = F.lower(F.substring(F.regexp_replace(t, "^-+|-+$", ""), 1, most))
    return F.when(plain == "", "query").otherwise(plain)


def similar_titles(a: ColumnLike, b: ColumnLike, least: float = 0.8) -> Column:
    """One contains the other, or their words overlap by more than `least` of the larger set."""
    x, y = normalize_title(a), normalize_title(b)
    wx, wy = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    share = F.size(F.array_intersect(wx, wy)) / F.greatest(F.size(wx), F.size(wy), F.lit(1))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x) | (share > least))


def citekeys(col: ColumnLike) -> Column:
    """Distinct pandoc keys (@key), trailing punctuation off, sorted."""
    found = F.regexp_extract_all(text_or_empty(col), F.lit("(?<![\\w.])@([A-Za-z0-9_][A-Za-z0-9_:.#$%&+?<>~/-]*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda k: F.regexp_replace(k, "[.,;:)\\]}]+$", "")), lambda k: k != "")))


# Patterns of author-year citations; a surname, maybe a second one, maybe "et al.".
_SURNAME = "[A-Z][a-zA-ZÀ-ÿ\\-']+"
_AUTHORS = f"{_SURNAME}(?:\\s+(?:and|&|et)\\s+{_SURNAME})?(?:\\s+et\\s+al\\.)?"
NARRATIVE = f"({_AUTHORS})\\s*\\((\\d{{4}})\\)"
PARENTHETICAL = "\\(([A-Z][a-zA-ZÀ-ÿ\\-'\\s&,;.]+\\d{4}[a-zA-ZÀ-ÿ\\-'\\s&,;.0-9]*)\\)"
SINGLE = f"({_AUTHORS}),?\\s*(\\d{{4}})"


def citations(col: ColumnLike) -> Column:
    """array<struct<author, year, raw>>: narrative citations, then those in parentheses; the first of each (author, year)."""

    def entry(raw: Column, pattern: str, wrap: bool) -> Column:
        author = F.trim(F.regexp_replace(F.regexp_extract(raw, pattern, 1), "\\s+", " "))
        shown = F.concat(F.lit("("), F.trim(raw), F.lit(")")) if wrap else F.trim(raw)
        return F.struct(author.alias("author"), F.regexp_extract(raw, pattern, 2).alias("year"), shown.alias("raw"))

    t = text_or_empty(col)
    told = F.transform(F.regexp_extract_all(t, F.lit(NARRATIVE), F.lit(0)), lambda m: entry(m, NARRATIVE, False))
    bodies = F.regexp_extract_all(t, F.lit(PARENTHETICAL), F.lit(1))
    inside = F.transform(F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(SINGLE), F.lit(0)))), lambda m: entry(m, SINGLE, True))
    return first_of_each(F.concat(told, inside), lambda e: F.concat_ws("\u0001", F.lower(e["author"]), e["year"]))


def surname(col: ColumnLike) -> Column:
    """`et al.` off, the first of two authors."""
    t = F.regexp_replace(text_or_empty(col), "\\s+et\\s+al\\.?", "")
    return F.trim(F.element_at(F.split(t, "\\s+(?:and|&|et)\\s+"), 1))


# What a publisher's notice says.
NOTICES = ("abstract is not available", "preview has been provided", "access link")


def is_boilerplate(col: ColumnLike) -> Column:
    """Abstracts that hold a publisher's notice rather than a summary."""
    t = F.lower(text_or_empty(col))
    return reduce(lambda a, b: a | b, [t.contains(n) for n in NOTICES])
