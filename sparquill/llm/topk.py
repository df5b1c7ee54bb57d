"""Exact top-k by inner product, with MaxScore over signed term lists.

A vector's component d is a term of the list (d, +) if positive and of (d, -) if
negative, with its magnitude as weight; zero is absent. For a query, the lists whose
sign agrees with its own component add to a score and are bounded by the query's
weight times the list's largest weight; the others only take away. Documents are
traversed in blocks, each list keeping its largest weight per block. Lists are
sorted by bound; those whose bounds together stay below the query's threshold, the
score of its k-th best so far, are non-essential: a document in none of the
essential lists can't reach the threshold. The essential lists are traversed, then
the others are probed from the largest bound down, for documents whose partial score
and remaining bounds are still competitive, and last the lists that take away. A
block without essential lists is passed over.

Every task keeps the k best of each query over its own rows (a shard); a window
merges the shards. Queries are read to the driver in blocks of at most
`query_block`, broadcast and searched block by block, the shards' bests being written
each time, so what is held is bounded whatever the number of queries. A first threshold for each query comes from rows of the
query block itself, so that shards report only what can still be among the k best.

Scores are exact: in double precision while dim * max^2 stays below 2^53, else in
integers of any size, saturated to the long range in the result; components
saturate at 1e300.

Defined results: ties go to the smaller id; vectors that are null or hold a null,
NaN or infinite component, and null ids, take no part; shorter vectors are padded
with zeros; a repeated id counts once as a query and by each of its rows as a
candidate of others, never of itself; other columns are ignored; with no query or no
other row the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.llm.common import Batch, fresh_dir, map_batches

SCALE = 1024
QUERY_BLOCK = 8192
BLOCK = 4096
SEED_ROWS = 2048
_CHUNK = 8
_EXACT = 1 << 53
#: Components saturate here, so that a scaled one stays finite.
_HUGE = 1e300

RESULT = "query_id long, vec_id long, score long"


def scaled(vector: list[float], scale: int = SCALE) -> list[int]:
    """floor(scale * x) of each component, x as double."""
    x = np.floor(np.clip(np.asarray(vector, np.float64), -_HUGE, _HUGE) * scale)
    return [int(v) for v in x]


def _matrix(rows: list[list[int]], width: int = 0) -> np.ndarray:
    """Rows as doubles while these are exact, else as Python integers."""
    width = max([width, *map(len, rows)])
    top = max((abs(v) for r in rows for v in (min(r, default=0), max(r, default=0))), default=0)
    out = np.zeros((len(rows), width), np.float64 if top < _EXACT else object)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _exactly(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of a type in which their inner products are exact."""
    top = lambda x: float(np.abs(x).max()) if x.size else 0.0
    if a.dtype == object or b.dtype == object or top(a) * top(b) * a.shape[1] >= _EXACT:
        whole = np.frompyfunc(int, 1, 1)
        return whole(a).astype(object), whole(b).astype(object)
    return a, b


class Lists:
    """The signed lists of a block of vectors, as columns of weights (zero: absent)."""

    def __init__(self, x: np.ndarray):
        self.weights = np.ascontiguousarray(np.concatenate([np.maximum(x, 0), np.maximum(-x, 0)], axis=1).T)
        self.largest = self.weights.max(axis=1)


def search_block(lists: Lists, query: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, score) of the block's rows that score at least the threshold; maybe others below it are left out, none above."""
    own = np.concatenate([np.maximum(query, 0), np.maximum(-query, 0)])
    dim = len(query)
    bounds = own * lists.largest
    order = np.argsort(bounds, kind="stable")
    order = order[bounds[order] > 0]
    sums = np.cumsum(bounds[order])
    cut = int(np.searchsorted(sums, threshold, side="left")) if len(order) else 0  # lists order[:cut] are non-essential
    if cut == len(order) and threshold > 0:
        return np.empty(0, np.int64), np.empty(0, query.dtype)
    if threshold <= 0:  # a row in no list at all may still be wanted
        rows, scores = np.arange(lists.weights.shape[1]), np.zeros(lists.weights.shape[1], query.dtype)
        cut = 0
    else:
        rows = scores = None
    essential = order[cut:]
    traversed = own[essential] @ lists.weights[essential] if len(essential) else None
    if rows is None:
        assert traversed is not None
        scores = traversed
        rest = sums[cut - 1] if cut else 0
        rows = np.flatnonzero((scores > 0) & (scores + rest >= threshold))
        scores = scores[rows]
    elif traversed is not None:
        scores = traversed
    for end in range(cut, 0, -_CHUNK):  # probe from the largest bound down
        if not len(rows):
            break
        start = max(0, end - _CHUNK)
        terms = order[start:end]
        scores = scores + own[terms] @ lists.weights[np.ix_(terms, rows)]
        rest = sums[start - 1] if start else 0
        live = scores + rest >= threshold
        rows, scores = rows[live], scores[live]
    against = np.concatenate([own[dim:], own[:dim]])  # the query's weight on lists of the other sign
    terms = np.flatnonzero(against * lists.largest)
    terms = terms[np.argsort(-(against * lists.largest)[terms], kind="stable")]
    for start in range(0, len(terms), _CHUNK):
        if not len(rows):
            break
        part = terms[start : start + _CHUNK]
        scores = scores - against[part] @ lists.weights[np.ix_(part, rows)]
        live = scores >= threshold
        rows, scores = rows[live], scores[live]
    return rows, scores


class Best:
    """The k best of each query: highest score, then smallest id."""

    def __init__(self, queries: int, k: int, thresholds: np.ndarray, kind):
        self.k, self.thresholds = k, thresholds
        self.scores = [np.empty(0, kind)] * queries
        self.ids = [np.empty(0, np.int64)] * queries

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(ids):
            return
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        if scores.dtype == object:
            keep = np.asarray(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k])
        else:
            keep = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[keep], ids[keep]
        if len(keep) == self.k:
            self.thresholds[q] = max(self.thresholds[q], self.scores[q][-1])


def _seed(ids: np.ndarray, x: np.ndarray, k: int, rows: int) -> np.ndarray:
    """A lower bound of each query's k-th best score, from the block's own first rows; -inf where there are too few."""
    y, other = x[:rows], ids[:rows]
    found = np.full(len(x), -np.inf, x.dtype if x.dtype == object else np.float64)
    for at in range(0, len(x), 512):
        s = (x[at : at + 512] @ y.T).astype(found.dtype)
        if s.dtype == object:
            s = _saturated(s)
        s[ids[at : at + 512, None] == other[None, :]] = -np.inf
        if s.shape[1] >= k:
            found[at : at + 512] = np.sort(s, axis=1)[:, -k] if s.dtype == object else np.partition(s, -k, axis=1)[:, -k]
    return found


def _to_long(x) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(x)))


def _saturated(scores: np.ndarray) -> np.ndarray:
    """Python integers within the long range, so that what saturates ties everywhere alike."""
    return np.frompyfunc(_to_long, 1, 1)(scores).astype(object)


def _search(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, scale: int, block: int, seed_rows: int) -> tuple[DataFrame, Broadcast]:
    """Every shard's candidates for one block of queries, and what was broadcast for them."""
    exact = _exactly(queries, queries)[0]
    sent = vectors.sparkSession.sparkContext.broadcast((ids, queries, _seed(ids, exact, k, seed_rows)))

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        ids, queries, thresholds = sent.value
        best = Best(len(ids), k, thresholds.copy(), np.float64)
        for names, rows in _blocks(batches, block, scale):
            x = _matrix(rows, queries.shape[1])
            q = np.pad(queries, ((0, 0), (0, x.shape[1] - queries.shape[1]))) if x.shape[1] > queries.shape[1] else queries
            x, q = _exactly(x, q)
            lists = Lists(x)
            for i in range(len(ids)):
                at, scores = search_block(lists, q[i], best.thresholds[i])
                if scores.dtype == object:
                    scores = _saturated(scores)
                other = names[at] != ids[i]
                best.add(i, scores[other], names[at][other])
        for i in range(len(ids)):
            n = len(best.ids[i])
            if n:
                yield {"query_id": [int(ids[i])] * n, "vec_id": best.ids[i], "score": [_to_long(s) for s in best.scores[i]]}

    return map_batches(vectors, run, RESULT, rows=block), sent


def _blocks(batches: Iterable[Batch], size: int, scale: int) -> Iterator[tuple[np.ndarray, list[list[int]]]]:
    names: list[int] = []
    rows: list[list[int]] = []
    for b in batches:
        for name, v in zip(b["id"], b["x"], strict=True):
            names.append(name)
            rows.append(scaled(v, scale))
            if len(rows) == size:
                yield np.asarray(names, np.int64), rows
                names, rows = [], []
    if rows:
        yield np.asarray(names, np.int64), rows


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, query_block: int = QUERY_BLOCK, block: int = BLOCK, seed_rows: int = SEED_ROWS) -> DataFrame:
    """For the rows where is_query holds (a condition on columns of vectors): query_id, rank from 1, vec_id, score."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    asked = usable.where(is_query).select(F.col(key).cast("long").alias("id"), x.alias("x"))
    asked = asked.groupBy("id").agg(F.min("x").alias("x"))
    rows = usable.select(F.col(key).cast("long").alias("id"), x.alias("x"))
    spark = vectors.sparkSession
    path = fresh_dir(spark, "shard-bests")
    block_ids: list[int] = []
    block_rows: list[list[int]] = []

    def ask() -> None:
        """Search one block and write its shards' bests, so that no more than a block is held at once."""
        found, sent = _search(rows, np.asarray(block_ids, np.int64), _matrix(block_rows), k, scale, block, seed_rows)
        found.write.mode("append").parquet(path)
        sent.unpersist()

    for r in asked.toLocalIterator():
        block_ids.append(r.id)
        block_rows.append(scaled(r.x, scale))
        if len(block_ids) == query_block:
            ask()
            block_ids, block_rows = [], []
    ask()  # the rest, maybe none: then an empty table
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = spark.read.schema(RESULT).parquet(path).withColumn("rank", F.row_number().over(by))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
