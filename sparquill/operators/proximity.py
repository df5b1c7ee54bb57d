"""Words near each other: NEAR over texts, and over stored postings with positions.

Phrases are near if each occurs in one column such that at most `distance` tokens lie
between the end of any of them and the start of the last: they may overlap, and come in
any order. Texts are passed over once, whatever their length: of each phrase the last
place so far is kept, which is the best for every place to come.

Defined results: null and empty texts hold nothing; phrases never meet across columns; a
phrase given twice is met by one occurrence; no phrases is a ValueError.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions import text as X

#: Fixed value: the distance where none is given.
DISTANCE = 10
_BODY = re.compile(r'((?:[^,"]|"[^"]*")*)(?:,\s*(\d+)\s*)?')
_PHRASE = re.compile(r'\s*(?:"([^"]*)"|([^\s",*]+))\s*(\*)?\s*')


@dataclass(frozen=True)
class Phrase:
    """Adjacent words, folded; with prefix, the last is a beginning."""

    words: tuple[str, ...]
    prefix: bool = False


def phrase(text: str, prefix: bool = False) -> Phrase:
    words = tuple(re.findall(r"[^\W_]+", text.lower()))
    if not words:
        raise ValueError(f"no words in {text!r}")
    return Phrase(words, prefix)


def parse_near(body: str) -> tuple[list[Phrase], int]:
    """Phrases and distance of what stands in NEAR's parentheses; ValueError if it can't be read."""
    m = _BODY.fullmatch(body)
    if not m:
        raise ValueError(f"can't read NEAR({body})")
    found, at, inner = [], 0, m[1].strip()
    while at < len(inner):
        p = _PHRASE.match(inner, at)
        if not p:
            raise ValueError(f"can't read {inner[at:]!r}")
        found.append(phrase(p[2] if p[1] is None else p[1], bool(p[3])))
        at = p.end()
    if not found:
        raise ValueError("NEAR of nothing")
    return found, DISTANCE if m[2] is None else int(m[2])


def _met(starts: list[Column], phrases: list[Phrase], distance: int) -> Column:
    """Whether the phrases, which start at the places in `starts`, are near."""
    def marked(s: Column, k: int) -> Column:
        return F.transform(s, lambda i: F.struct(i.cast("long").alias("i"), F.lit(k).alias("k")))

    events = F.array_sort(F.concat(*[marked(s, k) for k, s in enumerate(starts)]))
    far = -(1 << 40)
    first = F.struct(*[F.lit(far).cast("long").alias(f"p{k}") for k in range(len(phrases))], F.lit(False).alias("hit"))

    def step(last: Column, x: Column) -> Column:
        now = [F.when(x["k"] == k, x["i"]).otherwise(last[f"p{k}"]) for k in range(len(phrases))]
        near = reduce(lambda a, b: a & b, [p + len(ph.words) + distance >= x["i"] for p, ph in zip(now, phrases, strict=True)])
        return F.struct(*[p.alias(f"p{k}") for k, p in enumerate(now)], (last["hit"] | near).alias("hit"))

    met = F.aggregate(events, first, step, lambda last: last["hit"])
    return F.coalesce(reduce(lambda a, b: a & b, [F.size(s) > 0 for s in starts]), F.lit(False)) & met


def near(tokens: Column, phrases: list[Phrase], distance: int = DISTANCE) -> Column:
    """Whether the phrases are near in an array of tokens."""
    if not phrases:
        raise ValueError("NEAR of nothing")

    def starts(placed: Column, all_tokens: Column, p: Phrase) -> Column:
        def here(x: Column) -> Column:
            each = []
            for k, w in enumerate(p.words):
                t = x["t"] if k == 0 else F.try_element_at(all_tokens, x["i"] + F.lit(k + 1))
                each.append(F.startswith(t, F.lit(w)) if p.prefix and k == len(p.words) - 1 else t == w)
            return F.coalesce(reduce(lambda a, b: a & b, each), F.lit(False))

        return F.transform(F.filter(placed, here), lambda x: x["i"])

    def over(t: Column) -> Column:
        placed = F.transform(t, lambda x, i: F.struct(x.alias("t"), i.alias("i")))
        return X.bound(placed, lambda pl: X.bound(F.array(*[starts(pl, t, p) for p in phrases]), lambda s: _met([s[k] for k in range(len(phrases))], phrases, distance)))

    return X.bound(tokens, over)


def positions(records: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(token, node_id, col, pos): a row per occurrence in the columns; write it bucketed or sorted by token to prune later reads."""
    each = [records.select(F.col(key).alias("node_id"), F.lit(c).alias("col"), F.posexplode(X.folded_tokens(c)).alias("pos", "token")) for c in columns]
    return reduce(lambda a, b: a.unionByName(b), each).where("node_id is not null").select("token", "node_id", "col", "pos")


def near_from_positions(post: DataFrame, phrases: list[Phrase], distance: int = DISTANCE) -> DataFrame:
    """(node_id, col) where the phrases are near, from stored positions: only the lists of their words are read.

    A task gathers, of one column of one node, places of the phrases' words alone.
    """
    if not phrases:
        raise ValueError("NEAR of nothing")
    asked = [(w, p.prefix and k == len(p.words) - 1) for p in phrases for k, w in enumerate(p.words)]
    asked = list(dict.fromkeys(asked))
    is_word = [F.startswith("token", F.lit(w)) if beginning else F.col("token") == w for w, beginning in asked]
    lists = post.where(reduce(lambda a, b: a | b, is_word)).groupBy("node_id", "col").agg(*[F.collect_set(F.when(c, F.col("pos"))).alias(f"w{i}") for i, c in enumerate(is_word)])

    def back(column: str, k: int) -> Column:
        return F.transform(column, lambda i: i - k)

    def starts(p: Phrase) -> Column:
        return reduce(F.array_intersect, [back(f"w{asked.index((w, p.prefix and k == len(p.words) - 1))}", k) for k, w in enumerate(p.words)])

    return lists.where(_met([starts(p) for p in phrases], phrases, distance)).select("node_id", "col")
