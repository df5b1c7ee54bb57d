"""SimHash near-duplicates, linked through the general pigeonhole principle.

fingerprints(docs) gives each whole text a 64-bit fingerprint: A-Z are lower-cased,
words are runs of bytes other than space and 0x09-0x0D, shingles are `size`
consecutive words joined by a space (the whole sequence if there are fewer), each
hashed by XXH64 with seed 42; a bit is 1 if more than half of the hashes set it.

link(fingerprints) finds which distinct fingerprints differ in at most `radius`
bits, exactly:

* The 64 bits are dealt into m partitions, correlated bits together, from a bounded
  sample of fingerprints (`sample_size`); the sample decides cost, never results.
* If partition i gets threshold t_i and the thresholds sum to radius - m + 1, two
  fingerprints within the radius are within t_i in at least one partition (the
  general pigeonhole principle; -1 leaves a partition out). For every m, dynamic
  programming picks the thresholds of least estimated cost: keys to be made and
  candidates to be verified. The cheapest m is used, so that a longer table gets
  more selective keys.
* A partition with threshold t is probed by the keys that leave out t of its bits;
  fingerprints within t share at least one. Rows are dealt by key and sorted, and
  each group is verified in numpy. A task gives a spanning forest of the links it
  finds, not every pair, so a dense group costs no more rows than it has members.
* Keys that hold many fingerprints are cut into k chunks and dealt as pairs of
  chunks, k growing with the root of the group; every pair meets in some task.

classes(docs) joins the components back: one row per document.

keep_one(docs) filters documents. Three bits are few for texts of a similarity of 0.8
(about one pair in four), so it searches once more, exactly, among the shingle sets:

* Sets of sizes x <= y with a similarity of s differ in at most x * (1 - s) / s hashes.
  The hashes' range is cut into more buckets than that, by classes of size; a set gives a
  key for each bucket with two hashes or more, or fewer where it is too small for that.
  Two such sets then share a number of keys that each of them knows, wherever the edits
  are (set_keys).
* A text's keys are put in one order of all keys, rarest first. A pair is a candidate under
  the first key that it shares and not under every one: only where each text has as many
  keys left as the two must share, and where none of the keys just before is shared too.
* Under a key a text is verified against its nearest of other components; then whatever
  pairs are still apart and not yet verified are verified, all of them. Only texts in such
  pairs are read again for their sets.

Defined results: a text without words (null and empty too) has fingerprint zero and
is linked like any other; repeated rows and null ids give a row each, a null id
never names a component that has another id; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.llm.common import Batch, map_batches, store, text_bytes
from sparquill.llm.components import components

BITS = 64
RADIUS = 3
SHINGLE = 3
SAMPLE = 4096
#: Estimated seconds to make, move and sort a key, and to verify a candidate.
KEY_S, VERIFY_S = 2e-6, 4e-9
#: A key with more fingerprints than this is cut into ceil(sqrt(n / CHUNK)) chunks.
HEAVY, CHUNK = 1024, 256
#: Where groups are verified on texts: the similarity and its shingles' words.
SIMILARITY, WORDS = 0.8, 5
#: How many nearest texts of other classes a text is verified against at first, under every key; the rest
#: follows where classes stay apart, so this decides cost, never results.
NEAREST = 2
#: How many of the keys ahead of it each of a text's keys knows; pairs that share one of them met there. Decides cost, never results.
BEFORE = 16
#: 64-bit words of a set's parities.
SKETCH = 8
#: Least sizes of the classes of set size, each twice the one before, and the mean content of a bucket at the top of a class.
_SIZES, FILL = 2 ** np.arange(33, dtype=np.int64), 3.0
#: A key of more texts than this is cut into parts of so many at first, and into pairs of chunks for what stays apart.
DENSE, PART = 8192, 2048
#: Keys of more texts are compared by aggregation, not within a task.
LARGE_KEY = 1 << 16
_AT_ONCE = 1 << 16
_PARITIES = [f"p{i}" for i in range(SKETCH)]
_BEFORE = [f"b{i}" for i in range(BEFORE)]


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text's UTF-8 bytes."""
    words = raw.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), _AT_ONCE):
        part = b"".join([xxhash.xxh64_digest(s, 42) for s in shingles[at : at + _AT_ONCE]])
        votes += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(shingles)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        for b in batches:
            yield {"doc_id": b["k"], "fp": [signed(fingerprint(raw, size)) for raw in b["t"]]}

    rows = docs.select(F.col(key).cast("long").alias("k"), text_bytes(text).alias("t"))
    return map_batches(rows, run, "doc_id long, fp long")


# --- the plan: partitions, thresholds, keys


def _bits(fps: np.ndarray) -> np.ndarray:
    return ((fps[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)


def group_bits(fps: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near-equal width; each grows by the bit most correlated with what it has."""
    x = _bits(fps)
    x -= x.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0))
    norm[norm == 0] = 1.0
    like = np.abs((x / norm).T @ (x / norm))
    np.fill_diagonal(like, 0.0)
    left, groups = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        pool = sorted(left)
        group = [max(pool, key=lambda b: (like[b, pool].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            nearest = max(sorted(left), key=lambda b: (like[b, group].sum(), -b))
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def _distances(fps: np.ndarray, bits: list[int], radius: int) -> np.ndarray:
    """Share of pairs at distance 0..radius within the bits: the larger of the sample's and that of independent bits."""
    p = _bits(fps)[:, bits].mean(axis=0)
    differ = 2 * p * (1 - p)
    independent = np.zeros(radius + 1)
    independent[0] = 1.0
    for d in differ:
        independent[1:] = independent[1:] * (1 - d) + independent[:-1] * d
        independent[0] *= 1 - d
    mask = np.uint64(sum(1 << b for b in bits))
    part = fps & mask
    counts = np.zeros(radius + 1)
    for at in range(0, len(part), 256):
        found = np.bitwise_count(part[at : at + 256, None] ^ part[None, :])
        counts += np.bincount(found[found <= radius], minlength=radius + 1)[: radius + 1]
    counts[0] -= len(part)
    return np.maximum(independent, counts / max(1, len(part) * (len(part) - 1)))


def _cost(share: np.ndarray, width: int, t: int, n: int) -> float:
    if t < 0 or t > width:
        return 0.0 if t < 0 else float("inf")
    candidates = sum(share[d] * comb(width - d, t - d) for d in range(t + 1)) * n * n / 2
    return n * comb(width, t) * KEY_S + candidates * VERIFY_S


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (costs[i][t + 1] is partition i's cost at t) that sum to total, at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for had, (cost, chosen) in best.items():
            for t, more in enumerate(options, -1):
                if had + t not in after or cost + more < after[had + t][0]:
                    after[had + t] = cost + more, [*chosen, t]
        best = after
    return best[total]


def masks(fps: np.ndarray, n: int, radius: int = RADIUS) -> list[int]:
    """Unsigned masks; fingerprints within the radius agree under at least one of them."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, radius + 4):
        groups = group_bits(fps, m)
        shares = [_distances(fps, g, radius) for g in groups]
        costs = [[_cost(s, len(g), t, n) for t in range(-1, radius + 1)] for s, g in zip(shares, groups, strict=True)]
        cost, chosen = allocate(costs, radius - m + 1)
        if best is None or cost < best[0]:
            best = cost, list(zip(groups, chosen, strict=True))
    assert best is not None
    found = []
    for group, t in best[1]:
        if t >= 0:
            found += [sum(1 << b for b in group if b not in out) for out in combinations(group, t)]
    return found


# --- verification


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among fps, breadth first; pairs of positions."""
    left, found = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[u]) <= radius
            if near.any():
                hit = left[near]
                found += [(int(u), int(v)) for v in hit]
                queue += list(hit)
                left = left[~near]
    return found


class _Sets:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def links_in_groups(group: np.ndarray, fps: np.ndarray, radius: int, small: int = 48) -> list[tuple[int, int]]:
    """A spanning forest of the links between fingerprints of the same group; group is sorted."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    of_row = np.repeat(sizes, sizes)
    pairs: list[tuple[int, int]] = []
    at = np.flatnonzero((of_row > 1) & (of_row <= small))
    for step in range(1, small):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= radius]
        pairs += zip(fps[near].tolist(), fps[near + step].tolist(), strict=True)
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        own = fps[s : s + n]
        pairs += [(int(own[i]), int(own[j])) for i, j in _forest(own, radius)]
    sets = _Sets()
    return [(a, b) for a, b in pairs if a != b and sets.join(a, b)]


def _in_groups(search, names: list[str]):
    """mapInArrow over rows sorted by their first three columns: search(group numbers, other columns) per run of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: np.ndarray, columns: np.ndarray) -> pa.RecordBatch:
            found = search(group, list(columns)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(names))], names=names)

        held: list[np.ndarray] = []  # the last group may go on in the next batch; joined once, when it ends
        for b in batches:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)])
            if not rows.shape[1]:
                continue
            held.append(rows)
            if len(held) > 1 and (rows[:3, -1] == held[0][:3, 0]).all():
                continue
            whole = np.concatenate(held, axis=1)
            new = np.r_[True, (whole[:3, 1:] != whole[:3, :-1]).any(axis=0)]
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield out(np.cumsum(new[:last]), np.ascontiguousarray(whole[3:, :last]).view(np.uint64))
            held = [whole[:, last:]]
        if held:
            whole = np.concatenate(held, axis=1)
            yield out(np.zeros(whole.shape[1], np.int64), np.ascontiguousarray(whole[3:]).view(np.uint64))

    return run


def _deal(rows: DataFrame, radius: int, sample_size: int, heavy: int) -> DataFrame | None:
    """rows (fp, ...) under every key, dealt and sorted by (code, value, unit); None if there is nothing to compare."""
    n = rows.count()
    if n < 2:
        return None
    sample = np.asarray([r.fp for r in rows.select("fp").orderBy(F.xxhash64("fp")).limit(sample_size).collect()], np.int64).view(np.uint64)
    chosen = F.array(*[F.lit(signed(m)).cast("long") for m in masks(sample, n, radius)])
    keyed = lambda df: df.select("*", F.posexplode(chosen).alias("code", "mask")).withColumns({"code": F.col("code").cast("long"), "value": F.col("fp").bitwiseAND(F.col("mask"))}).drop("mask")
    # Large keys are found from one fingerprint in so many: a key missed here is only a larger group.
    one_in = 8
    seen = keyed(rows.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(one_in)) == 0))
    large = store(seen.groupBy("code", "value").agg((F.count("*") * one_in).alias("n")).where(F.col("n") > heavy // 2), "heavy-keys")
    names = [c for c in rows.columns if c != "fp"]
    dealt = keyed(rows)
    if large.isEmpty():
        dealt = dealt.withColumn("unit", F.lit(0).cast("long"))
    else:
        k = F.ceil(F.sqrt(F.col("n") / F.lit(float(CHUNK)))).cast("long")
        split = dealt.join(large, ["code", "value"], "left").withColumn("k", F.coalesce(k, F.lit(1).cast("long")))
        split = split.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        dealt = split.withColumn("unit", F.least("own", "other") * F.col("k") + F.greatest("own", "other"))
    return dealt.select("code", "value", "unit", "fp", *names).repartition("code", "value", "unit").sortWithinPartitions("code", "value", "unit")


def link(distinct: DataFrame, radius: int = RADIUS, sample_size: int = SAMPLE, heavy: int = HEAVY) -> DataFrame:
    """(fp) rows, all distinct, to (a, b): links that connect whatever the radius connects."""
    dealt = _deal(distinct.select("fp"), radius, sample_size, heavy)
    if dealt is None:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    return dealt.mapInArrow(_in_groups(lambda group, columns: np.asarray(links_in_groups(group, columns[0], radius), np.uint64).reshape(-1, 2), ["a", "b"]), "a long, b long")


# --- verified similarity, beyond the radius of the fingerprints


def _met(group: np.ndarray, fp: np.ndarray, other: np.ndarray, root: np.ndarray, told: np.ndarray, radius: int, other_radius: int, nearest: int, may=None) -> np.ndarray:
    """Positions (i, j), i < j: each row with its nearest rows of other roots in its group, if both fingerprints are near.

    With a small `nearest`, pairs grow with rows, however dense a group is; 0 stands for all. may(i, j) tells which pairs to keep.
    """
    far = BITS * 4
    found: list[np.ndarray] = []

    def kept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        pairs = np.stack([i, j])
        return pairs if may is None else pairs[:, may(i, j)]

    def distance(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        by_word, by_shingle = np.bitwise_count(fp[i] ^ fp[j]), np.bitwise_count(other[i] ^ other[j])
        out = by_word.astype(np.int16) + by_shingle
        out[(by_word > radius) | (by_shingle > other_radius) | (root[i] == root[j])] = far
        return out

    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    of_row = np.repeat(sizes, sizes)
    at = np.flatnonzero((of_row > 1) & (of_row <= 48))
    for step in range(1, 48):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        d = distance(at, at + step)
        near = d < far
        i, j, d = at[near], at[near] + step, d[near]
        found += [np.stack([i, d, j]), np.stack([j, d, i])] if nearest else [kept(i, j)]
    if found and nearest:  # the nearest few of each row
        i, d, j = np.concatenate(found, axis=1)
        order = np.lexsort((told[j], d, i))
        i, j = i[order], j[order]
        new = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        place = np.arange(len(i)) - np.repeat(new, np.diff(np.r_[new, len(i)]))
        found = [kept(i[place < nearest], j[place < nearest])]
    for s, n in zip(starts[sizes > 48].tolist(), sizes[sizes > 48].tolist(), strict=True):
        columns = s + np.argsort(told[s : s + n], kind="stable")  # so that ties go to the smaller
        for at in range(0, n, 128):
            if not nearest:
                rows, rest = columns[at : at + 128], columns[at + 1 :]
                i, j = np.nonzero(distance(rows[:, None], rest[None, :]) < far)
                once = j >= i
                found.append(kept(rows[i[once]], rest[j[once]]))
                continue
            rows = np.arange(s + at, min(s + at + 128, s + n))
            d = distance(rows[:, None], columns[None, :])
            for _ in range(nearest):
                best = d.argmin(axis=1)
                near = d[np.arange(len(rows)), best] < far
                found.append(kept(rows[near], columns[best[near]]))
                d[np.arange(len(rows)), best] = far
    if not found:
        return np.empty((2, 0), np.int64)
    i, j = np.concatenate(found, axis=1)
    return np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)


def pairs_in_groups(group: np.ndarray, fp: np.ndarray, other: np.ndarray, root: np.ndarray, told: np.ndarray, radius: int, other_radius: int, nearest: int) -> np.ndarray:
    """(root, root, told, told) of the pairs that met."""
    i, j = _met(group, fp, other, root, told, radius, other_radius, nearest)
    turned = root[i] > root[j]
    i, j = np.where(turned, j, i), np.where(turned, i, j)
    return np.unique(np.stack([root[i], root[j], told[i], told[j]], axis=1), axis=0)


def shingle_set(raw: bytes, size: int) -> bytes:
    """Sorted distinct 32-bit hashes of the text's shingles, as bytes."""
    words = raw.lower().split()
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.asarray([xxhash.xxh32_intdigest(s, 42) for s in shingles], np.uint32)).tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number (the finalizer of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _apart(n: int, similarity: float) -> int:
    """In how many hashes a set of n and one of the similarity can differ, at most."""
    return int(n * (1 - similarity) / similarity + 1e-6)


def keys_and_least(hashes: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """Keys of a set of sorted distinct 32-bit hashes, and how many of them any set of at least the similarity shares.

    Of k buckets at most d differ between two such sets, d being the most hashes that can.
    A set gives keys of its buckets with at least `content` hashes, the largest content of
    2, 1 and 0 that leaves k - d - (buckets with less) positive. Buckets that are equal hold
    equally many, so each that the set with the higher content gives is also the other's,
    and at least that difference of them are. A set that may be similar to a larger one of
    the next class of sizes gives keys of that class as well.
    """
    n = len(hashes)
    own = int(np.searchsorted(_SIZES, n, "right")) - 1
    found, least = [], n + 1
    for level in range(own, len(_SIZES) - 1):
        if level > own and n < similarity * _SIZES[level] - 1e-6:
            break
        top = int(_SIZES[level + 1]) - 1
        larger = min(top, n / similarity)
        d = int((n + larger) * (1 - similarity) / (1 + similarity) + 1e-6)
        k = max(int(top / FILL), _apart(top, similarity) + 2)
        bucket = (hashes.astype(np.uint64) * np.uint64(k)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, n])
        keys = np.add.reduceat(_mixed(hashes), starts)
        empty = k - len(starts)
        shared = {2: k - d - empty - int((sizes < 2).sum()), 1: k - d - empty, 0: k - d}
        content = next(c for c in (2, 1, 0) if shared[c] >= 1)
        if content:
            keys = keys[sizes >= content]
        else:
            keys = np.r_[keys, _mixed(np.setdiff1d(np.arange(k, dtype=np.uint64), bucket[starts]) + np.uint64(1 << 40))]
        least = min(least, shared[content])
        found.append(_mixed(keys + np.uint64(level << 48)))
    return np.concatenate(found), least


def set_keys(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a set of sorted distinct 32-bit hashes: any two sets of at least the similarity share one."""
    return keys_and_least(hashes, similarity)[0]


def same_keys(key: np.ndarray, told: np.ndarray) -> np.ndarray:
    """(group, told, keys) of keys that two texts or more have; keys of the same texts are one group, `keys` of them. key is sorted."""
    same = key[1:] == key[:-1]
    rows = np.stack([key, told.view(np.int64)], axis=1)[np.r_[False, same] | np.r_[same, False]]
    if not len(rows):
        return np.empty((0, 3), np.int64)
    rows = np.unique(rows, axis=0)
    starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    sizes = np.diff(np.r_[starts, len(rows)])
    rows[:, 0] = np.repeat(np.add.reduceat(_mixed(rows[:, 1].view(np.uint64)), starts), sizes).view(np.int64)
    rows, keys = np.unique(rows[np.repeat(sizes, sizes) > 1], axis=0, return_counts=True)
    return np.c_[rows, keys]


def same_large_keys(keyed: DataFrame) -> DataFrame:
    """(key, told) rows to the rows of same_keys, for keys of any size: their texts are counted and hashed by aggregation, so that no task holds them."""
    shared = store(keyed.distinct(), "large-keys")
    sets = shared.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("told")).alias("one"), F.bit_xor(F.xxhash64("told", F.lit(1))).alias("two"))
    groups = sets.where("n > 1").groupBy("n", "one", "two").agg(F.min("key").alias("key"), F.count("*").alias("keys"))
    return shared.join(groups.select("key", "keys"), "key")


def shared_keys(texts: DataFrame, similarity: float, words: int, large: int = LARGE_KEY, one_in: int = 64) -> DataFrame:
    """(key, told, keys): texts under every group of keys that the same texts have.

    Keys of more than about `large` texts are found from one text in `one_in` and go
    the way of same_large_keys; the others meet in one shuffle by key. A large key that the sample
    misses is only a larger group.
    """
    keyed = texts.select("told", "t").mapInArrow(_keys_of(similarity, words), "key long, told long")
    sampled = texts.select("told", "t").where(F.pmod(F.xxhash64("told"), F.lit(one_in)) == 0).distinct()
    of_sample = sampled.mapInArrow(_keys_of(similarity, words), "key long, told long")
    often = store(of_sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * one_in > large // 2).select("key"), "often")
    rare = often.isEmpty()
    zero = F.lit(0).cast("long")
    few = keyed if rare else keyed.join(often, "key", "left_anti")
    dealt = few.repartition("key").sortWithinPartitions("key").select("key", zero.alias("unit"), zero.alias("code"), "told")
    groups = dealt.mapInArrow(_in_groups(lambda group, c: same_keys(group, *c), ["key", "told", "keys"]), "key long, told long, keys long")
    if not rare:
        groups = groups.unionByName(same_large_keys(keyed.join(often, "key", "left_semi")))
    # a group of the same texts may come from several batches and tasks
    return store(groups.groupBy("key", "told").agg(F.sum("keys").alias("keys")), "same-keys")


def parities(hashes: np.ndarray) -> np.ndarray:
    """SKETCH words of bits; a bit is the parity of the hashes that fall on it, so sets differ in as many hashes as bits, or more."""
    bits = np.bincount(hashes % np.uint32(64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def may_be_similar(n: np.ndarray, sketch: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows x, y aren't ruled out by their sizes and parities (columns of sketch); rules out no similar pair."""
    out = np.empty(len(x), bool)
    for at in range(0, len(x), _AT_ONCE):
        i, j = x[at : at + _AT_ONCE], y[at : at + _AT_ONCE]
        least = np.bitwise_count(sketch[:, i] ^ sketch[:, j]).sum(axis=0, dtype=np.int64)
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        out[at : at + _AT_ONCE] = (small >= similarity * large - 1e-6) & (least <= (small + large) * (1 - similarity) / (1 + similarity) + 1e-6)
    return out


def may_meet_first(left: np.ndarray, least: np.ndarray, before: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Under one key, which pairs of rows x, y share none of the keys before it (columns of before) and may share as many from here on as they must.

    Two texts that share so many have that many left at the first key they share, and there nothing before is shared.
    """
    out = np.minimum(left[x], left[y]) >= np.minimum(least[x], least[y])
    for at in range(0, len(out), _AT_ONCE):
        own = at + np.flatnonzero(out[at : at + _AT_ONCE])
        one, two = before[:, x[own]], before[:, y[own]]
        for shift in range(len(before)):
            out[own] &= ~(one == np.roll(two, shift, axis=0)).any(axis=0)
    return out


def in_order(grouped: DataFrame) -> DataFrame:
    """The rows (key, told, keys, root, ...) of keys that several roots have, in one order of all keys in each text, rarest first.

    `left` counts the text's keys from here on; _BEFORE are the keys just before it, or else the text's own
    number, which no other text has.
    """
    several = grouped.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    from_last = Window.partitionBy("told").orderBy(F.desc("rows"), F.desc("key"))
    left = F.sum("keys").over(from_last.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = {name: F.coalesce(F.lead("key", i).over(from_last), "told") for i, name in enumerate(_BEFORE, 1)}
    return grouped.join(several.select("key", "rows"), "key").withColumns({"left": left} | before).drop("rows", "keys")


def _keys_of(similarity: float, words: int, most: int = 200_000):
    """mapInArrow over (told, t): (key, told); within a task a text gives its keys once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                keys, told = [], []
                for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if name not in seen:
                        if len(seen) >= most:
                            seen.clear()
                        seen.add(name)
                        keys.append(set_keys(np.frombuffer(shingle_set(raw.as_py(), words), np.uint32), similarity))
                        told.append(name)
                if keys:
                    columns = np.concatenate(keys).view(np.int64), np.repeat(np.asarray(told, np.int64), [len(k) for k in keys])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "told"])

    return run


def pairs_met(grouped: DataFrame, similarity: float, nearest: int) -> DataFrame:
    """(a, b, x, y): pairs of roots and texts, from the rows of in_order; a pair is seldom found twice.

    With `nearest`, each text and the nearest of its part of a key; without, all pairs of different
    roots that may share as many keys as they must, large keys being dealt as pairs of chunks.
    """
    per_key = grouped.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("least_root"), F.max("root").alias("most_root")).where("least_root <> most_root")
    parts = F.ceil(F.col("rows") / F.lit(float(DENSE))) if nearest else F.ceil(F.sqrt(F.col("rows") / F.lit(float(PART))))
    k = F.when(F.col("rows") > DENSE, parts).otherwise(1).cast("long")
    split = grouped.join(per_key.select("key", k.alias("k")), "key").withColumn("own", F.pmod(F.xxhash64("told", "key"), F.col("k")))
    unit = F.col("own")
    if not nearest:
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        unit = F.least("own", "other") * F.col("k") + F.greatest("own", "other")
    dealt = split.select("key", unit.alias("unit"), F.lit(0).cast("long").alias("zero"), "fp", "root", "told", "n", "least", "left", *_PARITIES, *_BEFORE)
    dealt = dealt.repartition("key", "unit").sortWithinPartitions("key", "unit")

    def search(group: np.ndarray, c: list[np.ndarray]) -> np.ndarray:
        root, told, n, least, left = (x.view(np.int64) for x in c[1:6])
        sketch, before = np.stack(c[6 : 6 + SKETCH]), np.stack(c[6 + SKETCH :])

        def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = may_be_similar(n, sketch, i, j, similarity)
            out[out] = may_meet_first(left, least, before, i[out], j[out])
            return out

        i, j = _met(group, c[0], c[0], root, told, BITS, BITS, nearest, may)
        turned = root[i] > root[j]
        i, j = np.where(turned, j, i), np.where(turned, i, j)
        return np.unique(np.stack([root[i], root[j], told[i], told[j]], axis=1), axis=0)

    names = ["a", "b", "x", "y"]
    return dealt.mapInArrow(_in_groups(search, names), ", ".join(f"{c} long" for c in names))


def similar_roots(members: DataFrame, texts: DataFrame, similarity: float, words: int, nearest: int = NEAREST) -> DataFrame:
    """(root, whole): classes that hold texts of at least the similarity in shingles of `words` words, joined.

    members: (told, first, root, fp, n, least, parities), a row for each distinct text, `first` a
    (none, doc_id, told) that has it; texts: (doc_id, told, t). Texts that share a key are candidates.
    Each is first verified against its `nearest` of other classes; of classes that stay apart, every
    other pair that may share as many keys as it must follows.
    """
    groups = shared_keys(texts, similarity, words)
    groups = store(in_order(groups.join(members.drop("first"), "told")), "similar-groups")
    places = members.select(F.col("first.doc_id").alias("doc_id"), "told")

    first = store(pairs_met(groups, similarity, nearest).distinct(), "candidate-pairs")
    edges = _verified(first, texts, places, similarity, words)
    joined = store(components(edges).select(F.col("node").alias("root"), F.col("root").alias("whole")), "joined")
    moved = groups.join(joined, "root", "left").withColumn("root", F.coalesce("whole", "root")).drop("whole")
    had = first.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"))
    rest = pairs_met(moved, similarity, 0).distinct().withColumns({"p": F.least("x", "y"), "q": F.greatest("x", "y")})
    rest = store(rest.join(had, ["p", "q"], "left_anti").drop("p", "q"), "rest-pairs")
    # a class that the first round moved is named by its whole in the second
    edges = edges.unionByName(_verified(rest, texts, places, similarity, words))
    return components(edges).select(F.col("node").alias("root"), F.col("root").alias("whole"))


def _verified(pairs: DataFrame, texts: DataFrame, places: DataFrame, similarity: float, words: int) -> DataFrame:
    """(a, b) of the pairs whose texts have at least the similarity; sets are made of one place of each text in a pair."""

    def to_sets(batches: Iterator[Batch]) -> Iterator[Batch]:
        for b in batches:
            yield {"told": b["told"], "s": [shingle_set(raw, words) for raw in b["t"]]}

    def verify(batches: Iterator[Batch]) -> Iterator[Batch]:
        for b in batches:
            kept = [(p, q) for p, q, s, t in zip(b["a"], b["b"], b["s"], b["t"], strict=True) if jaccard(s, t) >= similarity]
            yield {"a": [p for p, _ in kept], "b": [q for _, q in kept]}

    wanted = pairs.select(F.explode(F.array("x", "y")).alias("told")).distinct()
    here = store(places.join(wanted, "told", "left_semi"), "texts-in-pairs")
    found = texts.join(here, (texts["told"] == here["told"]) & texts["doc_id"].eqNullSafe(here["doc_id"]), "left_semi")
    sets = map_batches(found.select("told", "t"), to_sets, "told long, s binary")
    sets = store(sets.groupBy("told").agg(F.first("s").alias("s")), "shingle-sets")  # repeated rows of an id
    both = pairs.join(sets.withColumnRenamed("told", "x"), "x").join(sets.select(F.col("told").alias("y"), F.col("s").alias("t")), "y")
    return store(map_batches(both.select("a", "b", "s", "t"), verify, "a long, b long", rows=64).distinct(), "similar")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """Per document: fp and component_id, the smallest id its fingerprint reaches by links."""
    fps = store(fingerprints(docs, text, key, size), "fingerprints")
    return fps.join(component_of(fps, radius).drop("root"), "fp")


def component_of(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp) rows to (fp, root, component_id) per distinct fingerprint; root names the component."""
    distinct = store(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(link(distinct.select("fp"), radius))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = store(member, "members")
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return member.join(least, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, size: int = SHINGLE, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """Rows of docs, all columns: of each group of near-duplicates the row with the smallest id, nulls last.

    Groups are the components of the fingerprints' links, joined where two of them hold
    texts of at least the similarity in shingles of `words` words. Rows are told apart by
    id and text; of rows that repeat both, one stays.
    """
    told = F.xxhash64(text_bytes(text))

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        for b in batches:
            out: Batch = {"doc_id": b["doc_id"], "told": b["told"], "fp": [], "n": [], "least": []}
            sketch = []
            for raw in b["t"]:
                hashes = np.frombuffer(shingle_set(raw, words), np.uint32)
                out["fp"].append(signed(fingerprint(raw, size)))
                out["n"].append(len(hashes))
                out["least"].append(keys_and_least(hashes, similarity)[1])
                sketch.append(parities(hashes))
            yield out | dict(zip(_PARITIES, np.stack(sketch, axis=1).view(np.int64).tolist(), strict=True))

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), told.alias("told"), text_bytes(text).alias("t"))
    longs = ["doc_id", "told", "fp", "n", "least", *_PARITIES]
    fps = store(map_batches(rows, run, ", ".join(f"{c} long" for c in longs)), "fingerprints")
    roots = component_of(fps.select("doc_id", "fp"), radius).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "told"))
    per_text = fps.groupBy(*longs[1:]).agg(first.alias("first"))  # every distinct text, whatever fingerprint it shares
    member = store(per_text.join(roots, "fp"), "similar-members")
    merged = similar_roots(member, rows, similarity, words)
    whole = member.join(merged, "root", "left").withColumn("whole", F.coalesce("whole", "root"))
    kept = store(whole.groupBy("whole").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("id"), F.col("first.told").alias("h")), "kept")
    found = docs.join(kept, told.eqNullSafe(kept["h"]) & docs[key].cast("long").eqNullSafe(kept["id"]), "left_semi")
    again = fps.groupBy("doc_id", "told").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), F.col("told").alias("h"))
    if again.isEmpty():
        return found
    # rows that repeat id and text: the one whose JSON hashes least
    again = store(again, "repeated")
    same = told.eqNullSafe(again["h"]) & docs[key].cast("long").eqNullSafe(again["id"])
    order = Window.partitionBy(F.col(key).cast("long"), told).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
    place = uuid.uuid4().hex  # no column of the caller's has this name
    one = found.join(again, same, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return found.join(again, same, "left_anti").unionByName(one)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id."""
    found = classes(docs, text, key, radius, size)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
