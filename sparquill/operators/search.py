"""Ranked, auditable search over evidence nodes.

The index is two tables: postings(token, node_id) and node_stats(node_id, dl).
A search filters postings to the query's few tokens first, so that what is joined
and aggregated is the postings of those tokens, never the texts. Corpus statistics
(N, df, mean length) are over all nodes, whatever a search filters by.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import proximity

# BM25's parameters, the floor of a term's weight, limits of an expression.
K1, B, FLOOR = 1.2, 0.75, 1e-6
MOST_TERMS, MOST_REQUIRED, MOST_FALLBACK = 64, 32, 8
OVERFETCH, RRF = 4, 60

_CJK = re.compile("[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]")


def query_tokens(text: str) -> list[str]:
    """Tokens of a query, as X.index_tokens gives them for a column."""
    found: list[str] = []
    run = ""

    def flush() -> None:
        nonlocal run
        found.extend([run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)])
        run = ""

    for part in re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", text or ""):
        if _CJK.fullmatch(part):
            run += part
            continue
        flush()
        if re.match(r"\w", part, re.ASCII):
            found.append(part.lower())
    flush()
    return list(dict.fromkeys(found))


def postings(nodes: DataFrame, text: Column, key: str = "node_id") -> DataFrame:
    """(token, node_id), a row per occurrence; write it bucketed or sorted by token to prune later reads."""
    return nodes.select(F.explode(X.index_terms(text)).alias("token"), F.col(key).alias("node_id"))


def node_stats(nodes: DataFrame, text: Column, key: str = "node_id") -> DataFrame:
    """(node_id, dl)."""
    return nodes.select(F.col(key).alias("node_id"), F.size(X.index_terms(text)).alias("dl"))


def _frequency(terms: Column, token: str) -> Column:
    """How often a query token occurs; one with underscores is a phrase of adjacent terms."""
    parts = [p for p in token.split("_") if p]
    if not parts:
        return F.lit(0)
    if len(parts) == 1:
        return F.when(F.array_contains(terms, parts[0]), F.size(F.filter(terms, lambda t: t == parts[0]))).otherwise(0)
    at = lambda i: reduce(lambda a, b: a & b, [F.try_element_at(terms, i + k) == p for k, p in enumerate(parts)])
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(terms), F.lit(1))), lambda i: F.coalesce(at(i), F.lit(False)))
    return F.when(reduce(lambda a, b: a & b, [F.array_contains(terms, p) for p in parts]), F.size(places)).otherwise(0)


def bm25(indexed: DataFrame, terms: list[str], mode: str = "or", require: list[str] | None = None) -> DataFrame:
    """(node_id, score) of nodes that match.

    indexed: (node_id, tokens array of index terms), one row per node. A term listed
    as required and as query term counts twice. mode 'and' asks for every term.
    """
    ask = terms[:MOST_TERMS]
    must = list(dict.fromkeys(require or []))[:MOST_REQUIRED]
    wanted = list(dict.fromkeys([*ask, *must]))
    if not ask:
        return indexed.select("node_id", F.lit(0.0).alias("score")).where(F.lit(False))
    # Frequencies and length per node; texts don't travel further. The rows, a few numbers each, are
    # dealt once and read twice (statistics, scores), so that texts are tokenized once: the condition
    # below names the statistics, which keeps it above the exchange and the exchange the same for both.
    has = indexed.where("node_id is not null").select("node_id", F.size("tokens").alias("dl"), *[_frequency(F.col("tokens"), t).alias(f"f{i}") for i, t in enumerate(wanted)]).repartition("node_id")
    totals = has.agg(F.count("*").alias("n_nodes"), F.avg("dl").alias("mean"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))])
    hit = [F.col(f"f{i}") > 0 for i in range(len(wanted))]
    some = lambda words: reduce(lambda a, b: a | b, [hit[wanted.index(t)] for t in words])
    every = lambda words: reduce(lambda a, b: a & b, [hit[wanted.index(t)] for t in words], F.lit(True))
    kept = every([*must, *ask]) if mode == "and" else every(must) & some(ask)
    both = has.crossJoin(F.broadcast(totals)).where(F.when(F.col("n_nodes") > 0, kept))  # one row
    n = F.col("n_nodes").cast("double")
    length = F.lit(K1) * (1 - B + B * F.col("dl") / F.col("mean"))

    def part(i: int, times: int) -> Column:
        df, f = F.col(f"df{i}").cast("double"), F.col(f"f{i}").cast("double")
        idf = F.ln((n - df + 0.5) / (df + 0.5))
        return F.when(idf > 0, idf).otherwise(F.lit(FLOOR)) * f * (K1 + 1) / (f + length) * times

    return both.select("node_id", reduce(lambda a, b: a + b, [part(i, (t in ask) + (t in must)) for i, t in enumerate(wanted)]).alias("score"))


def bm25_from_postings(post: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """The same ranking of single terms from stored postings: only the terms' lists are read."""
    lists = post.where(F.col("token").isin(terms[:MOST_TERMS])).groupBy("token", "node_id").agg(F.count("*").cast("double").alias("f"))
    df = lists.groupBy("token").agg(F.count("*").alias("df"))  # a row per term
    totals = stats.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("mean"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(F.lit(FLOOR))
    joined = lists.join(F.broadcast(df), "token").join(stats, "node_id").crossJoin(F.broadcast(totals))
    length = F.lit(K1) * (1 - B + B * F.col("dl") / F.col("mean"))
    return joined.groupBy("node_id").agg(F.sum(weight * F.col("f") * (K1 + 1) / (F.col("f") + length)).alias("score"))


def like_scan(nodes: DataFrame, terms: list[str], content: str = "content") -> DataFrame:
    """Nodes whose content holds any of the first terms, literally; for when ranking finds nothing."""
    low = F.lower(F.col(content))
    any_of = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms[:MOST_FALLBACK]], F.lit(False))
    return nodes.where(any_of)


def search_nodes(nodes: DataFrame, query: str, top_k: int, *, mode: str = "or", require: list[str] | None = None, exclude: list[str] | None = None, where: Column | None = None, scope: DataFrame | None = None, fallback: bool = True) -> DataFrame:
    """nodes (node_id, paper_id, ordinal, content, ...) ranked: score desc, paper_id, ordinal; `rank` from 1.

    where and scope (paper_id) narrow what may be returned, not the statistics. An
    empty scope gives no rows. Excluded words are tested after the limit, so fewer
    than top_k rows may come back.
    """
    terms = query_tokens(query)
    must = [t for r in require or [] for t in query_tokens(r)]
    indexed = nodes.select("node_id", X.index_terms("content").alias("tokens"))
    scored = bm25(indexed, terms, mode, must)
    allowed = nodes if where is None else nodes.where(where)
    within = lambda df: df if scope is None else df.join(scope.select("paper_id").distinct(), "paper_id", "left_semi")
    eligible = within(allowed)
    # ranked without their texts, which only the top_k rows fetch
    top = within(allowed.select("node_id", "paper_id", "ordinal")).join(scored, "node_id").orderBy(F.desc("score"), "paper_id", "ordinal").limit(top_k)
    hits = within(allowed.join(F.broadcast(top.select("node_id", "score").distinct()), "node_id")).withColumn("match", F.lit("fts"))
    if fallback and terms:
        # one row or none, joined before the scan, which an empty one spares
        none = top.agg(F.count("*").alias("found")).where("found = 0")
        plain = like_scan(eligible.crossJoin(F.broadcast(none)).drop("found"), terms).withColumns({"score": F.lit(-999.0), "match": F.lit("fts")})
        hits = hits.unionByName(plain.orderBy("paper_id", "ordinal").limit(top_k))
    if exclude:
        low = F.lower("content")
        for t in exclude:
            if t.strip():
                hits = hits.where(~F.contains(low, F.lit(t.strip().lower())))
    # at most top_k rows are numbered
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "paper_id", "ordinal")))
    return ranked.withColumn("snippet", X.snippet("content", terms))


def roll_up(hits: DataFrame, top_k: int, evidence: int = 3, first: list[str] | None = None) -> DataFrame:
    """Ranked node hits to papers: reciprocal ranks summed, the first few evidences kept, ties as first seen.

    first: columns taken from a paper's best hit.
    """
    proof = F.struct("rank", *[c for c in ("node_id", "section", "snippet") if c in hits.columns])
    grouped = hits.groupBy("paper_id").agg(
        F.sum(1.0 / (RRF + F.col("rank"))).alias("score"),
        F.count("*").alias("hits"),
        F.min("rank").alias("best"),
        F.slice(F.array_sort(F.collect_list(proof)), 1, evidence).alias("evidence"),
        *[F.min_by(c, "rank").alias(c) for c in first or []],
    )
    return grouped.orderBy(F.desc("score"), "best").limit(top_k)


def search(nodes: DataFrame, query: str, top_k: int = 20, first: list[str] | None = None, **filters) -> DataFrame:
    """Paper-level search: four times as many nodes are ranked as papers are asked for."""
    return roll_up(search_nodes(nodes, query, max(OVERFETCH * top_k, top_k), **filters), top_k, first=first)


# --- silo search: terms, "phrases", AND, OR, NOT, prefix*, column:term, NEAR(terms and "phrases", distance)


_NEAR = re.compile(r'\s*(?:(\w+)\s*:\s*)?NEAR\s*\(((?:[^()"]|"[^"]*")*)\)')
_PART = re.compile(r'\s*(?:(\w+)\s*:\s*)?(?:"([^"]*)"(\*)?|(\()|(\))|([^\s()":]+))')


def parse_expression(text: str) -> list:
    """Tokens of the silo grammar; ValueError if quotes or parentheses don't close."""
    found, at, depth = [], 0, 0
    text = text.strip()
    while at < len(text):
        if m := _NEAR.match(text, at):
            found.append((m[1], *proximity.parse_near(m[2]), "near"))
            at = m.end()
            continue
        m = _PART.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read {text[at:]!r}")
        column, phrase, star, left, right, word = m.groups()
        at = m.end()
        depth += bool(left) - bool(right)
        if depth < 0:
            raise ValueError("a parenthesis closes that wasn't opened")
        found.append("(" if left else ")" if right else word if word in ("AND", "OR", "NOT") and not column else (column, phrase if phrase is not None else word, bool(star)))
    if depth:
        raise ValueError("a parenthesis doesn't close")
    return found


def expression_filter(text: str, columns: list[str]) -> Column:
    """A condition over text columns; NOT binds tightest, then AND (also implied), then OR.

    An expression that can't be read is taken as one phrase.
    """
    try:
        parts = parse_expression(text)
        position = 0

        def near(part: tuple) -> Column:
            column, phrases, distance, _ = part
            if column and column not in columns:
                raise ValueError("no such column")
            return reduce(lambda a, b: a | b, [proximity.near(X.folded_tokens(c), phrases, distance) for c in ([column] if column else columns)])

        def phrase(part: tuple) -> Column:
            if len(part) == 4:
                return near(part)
            column, words, star = part
            tokens = re.findall(r"[^\W_]+", words.lower())
            star = star or words.endswith("*")
            if not tokens or (column and column not in columns):
                raise ValueError("no words")
            joined = " " + " ".join(tokens) + ("" if star else " ")
            over = [column] if column else columns
            return reduce(lambda a, b: a | b, [F.contains(F.concat(F.lit(" "), F.array_join(X.folded_tokens(c), " "), F.lit(" ")), F.lit(joined)) for c in over])

        def atom() -> Column:
            nonlocal position
            if position >= len(parts):
                raise ValueError("something is missing")
            part = parts[position]
            position += 1
            if part == "(":
                found = either()
                if position >= len(parts) or parts[position] != ")":
                    raise ValueError("a parenthesis doesn't close")
                position += 1
                return found
            if isinstance(part, str):
                raise ValueError(f"{part} stands alone")
            return phrase(part)

        def without() -> Column:
            nonlocal position
            found = atom()
            while position < len(parts) and parts[position] == "NOT":
                position += 1
                found = found & ~atom()
            return found

        def both() -> Column:
            nonlocal position
            found = without()
            while position < len(parts) and parts[position] not in ("OR", ")"):
                position += parts[position] == "AND"
                found = found & without()
            return found

        def either() -> Column:
            nonlocal position
            found = both()
            while position < len(parts) and parts[position] == "OR":
                position += 1
                found = found | both()
            return found

        condition = either()
        if position < len(parts):
            raise ValueError("something is left over")
        return condition
    except ValueError:
        tokens = re.findall(r"[^\W_]+", text.lower())
        if not tokens:
            return F.lit(False)
        joined = " " + " ".join(tokens) + " "
        return reduce(lambda a, b: a | b, [F.contains(F.concat(F.lit(" "), F.array_join(X.folded_tokens(c), " "), F.lit(" ")), F.lit(joined)) for c in columns])


def silo_search(records: DataFrame, text: str, top_k: int = 20, columns: tuple[str, ...] = ("title", "authors", "abstract"), key: str = "paper_id") -> DataFrame:
    """Records of a silo that satisfy the expression, ranked by BM25 of its words over all columns."""
    cols = list(columns)
    plain = _NEAR.sub(lambda m: " " + re.sub(r",\s*\d+\s*$", "", m[2]) + " ", text)
    words = [w for w in re.findall(r"[^\W_]+", plain) if w not in ("AND", "OR", "NOT")]
    whole = F.concat_ws(" ", *cols)
    indexed = records.select(F.col(key).alias("node_id"), F.array_distinct(X.folded_tokens(whole)).alias("tokens"))
    scored = bm25(indexed, list(dict.fromkeys(w.lower() for w in words)))
    return records.where(expression_filter(text, cols)).join(scored.withColumnRenamed("node_id", key), key, "left").withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy(F.desc("score"), key).limit(top_k)
