"""Product codes of vectors, by Yinyang Lloyd rounds in integers.

train_and_code(vectors) turns components into integers, cuts vectors into PARTS equal
parts and gives each part position a codebook of ENTRIES entries, refined by ROUNDS
rounds: every part goes to its nearest entry, every entry becomes the floor of its
parts' mean. Then parts are assigned once more.

A part keeps an upper bound of the distance to its entry and, for each group of entries,
a lower bound of the distances to the group's other entries. Entries are grouped once, by
a few Lloyd rounds over the first codebook. After an update the upper bound grows by the
drift of the part's entry and each lower bound shrinks by the largest drift in its group.
While all lower bounds stay above the upper bound, the part keeps its entry unseen. Else the
distance to its entry is computed, and only groups whose bound is still not above it are
scanned. Bounds are rounded outwards, so that a group that is passed over has no entry as near;
all that is scanned is decided by integer squared distances, ties to the lower index.

A round is one pass over a written table, which holds a vector with its codes and bounds;
the task's sums and counts per entry are one more row of it. Sums are read as a column of
their own, added up, and only codebooks reach the driver (PARTS * ENTRIES * width numbers).

Defined results: vectors that are null or hold a null, NaN or infinite component take no
part; null ids are coded, yet don't start a codebook; ties of ids are ordered by vector; with
fewer than ENTRIES vectors there are fewer entries; shorter vectors are padded with zeros,
to the longest length and a multiple of PARTS; scaled components saturate at HUGE,
so that sums and squares stay in 64 bits; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, LongType, StringType, StructField, StructType

from sparquill.llm.common import store

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
GROUPS = 4
#: Scaled components saturate here: the squares of a part of 512 components fit a long.
HUGE = 1 << 26
_EXACT = float(1 << 53)
#: Bounds are kept as 32-bit floats and widened by more than these lose.
_WIDER, _NARROWER = np.float64(1 + 1e-6), np.float64(1 - 1e-6)
ROWS_AT_ONCE = 4096


@dataclass
class Codebooks:
    """entries: (parts, entries, width) integers; groups: each entry's group, per part; drift: how far each entry moved last."""

    entries: np.ndarray
    groups: np.ndarray
    n_groups: int
    drift: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer squared distances of rows to entries, as longs."""
    width = x.shape[1]
    top = float(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * top * top * width < _EXACT:  # every sum below is exact in double precision
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for k, e in enumerate(entries):
        d = x.astype(np.int64) - e
        out[:, k] = (d * d).sum(axis=1)
    return out


def group_entries(entries: np.ndarray, n_groups: int, rounds: int = 5) -> np.ndarray:
    """Each entry's group: a few Lloyd rounds over the entries themselves. Any grouping gives right results."""
    centres = entries[:: max(1, -(-len(entries) // n_groups))][:n_groups].astype(np.float64)
    found = np.zeros(len(entries), np.int64)
    for _ in range(rounds):
        found = ((entries[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(len(centres)):
            if (found == g).any():
                centres[g] = entries[found == g].mean(axis=0)
    return found


def start(seeds: np.ndarray, parts: int, n_groups: int) -> Codebooks:
    """Codebooks whose entries are the parts of the seeds (rows, in order)."""
    entries = seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2).astype(np.int64)
    groups = np.stack([group_entries(e, n_groups) for e in entries])
    return Codebooks(entries, groups, n_groups, np.zeros(entries.shape[:2]))


def moved(books: Codebooks, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
    """The codebooks after an update: floors of means, unused entries where they were."""
    used = counts > 0
    entries = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], books.entries)
    step = (entries - books.entries).astype(np.float64)
    return Codebooks(entries, books.groups, books.n_groups, np.sqrt((step * step).sum(axis=2)))


def assign_part(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: np.ndarray, groups: np.ndarray, drift: np.ndarray) -> int:
    """Move one part of all rows to its nearest entry, in place. Returns the number of distances computed."""
    fall = np.zeros(lower.shape[1])
    np.maximum.at(fall, groups, drift)
    upper += drift[code]
    upper *= _WIDER
    lower -= fall
    np.maximum(lower * _NARROWER, 0, out=lower)
    unsure = np.flatnonzero(lower.min(axis=1) <= upper)
    if not len(unsure):
        return 0
    gap = x[unsure].astype(np.int64) - entries[code[unsure]]
    best = (gap * gap).sum(axis=1)
    upper[unsure] = np.sqrt(best.astype(np.float64)) * _WIDER
    open_ = lower[unsure] <= upper[unsure, None]
    live = open_.any(axis=1)
    rows, best, open_ = unsure[live], best[live], open_[live]
    done = len(unsure)
    own, own_d = code[rows].copy(), best.copy()
    found, found_d = own.copy(), best.copy()
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(lower.shape[1]):
        members = np.flatnonzero(groups == g)
        at = np.flatnonzero(open_[:, g])
        if not len(members) or not len(at):
            continue
        d = squared(x[rows[at]], entries[members])
        done += d.size
        near = d.argmin(axis=1)  # the first, so the lowest index of the group
        near_d, near_k = d[np.arange(len(at)), near], members[near]
        better = (near_d < found_d[at]) | ((near_d == found_d[at]) & (near_k < found[at]))
        found[at[better]], found_d[at[better]] = near_k[better], near_d[better]
        seen.append((at, d, members))
    for at, d, members in seen:
        others = np.where(members[None, :] == found[at][:, None], np.iinfo(np.int64).max, d).min(axis=1)
        lower[rows[at], groups[members[0]]] = np.sqrt(others.astype(np.float64)) * _NARROWER
    # the entry that was left counts among its group's others now, if that group wasn't scanned
    left = np.flatnonzero(found != own)
    home = groups[own[left]]
    np.minimum.at(lower, (rows[left], home), np.sqrt(own_d[left].astype(np.float64)) * _NARROWER)
    code[rows] = found
    upper[rows] = np.sqrt(found_d.astype(np.float64)) * _WIDER
    return done


def _bounds(raw: list[bytes] | None, n: int, parts: int, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    if raw is None:  # nothing is known yet
        return np.full((n, parts), np.inf), np.zeros((n, parts, n_groups))
    both = np.frombuffer(b"".join(raw), "<f4").reshape(n, parts, 1 + n_groups).astype(np.float64)
    return both[:, :, 0].copy(), both[:, :, 1:].copy()


def _assign(x: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Codebooks) -> None:
    for p in range(x.shape[1]):
        at = np.ascontiguousarray(codes[:, p])
        up, low = np.ascontiguousarray(upper[:, p]), np.ascontiguousarray(lower[:, p])
        assign_part(x[:, p], at, up, low, books.entries[p], books.groups[p], books.drift[p])
        codes[:, p], upper[:, p], lower[:, p] = at, up, low


def _cells(b: pa.RecordBatch, width: int, parts: int) -> np.ndarray:
    """The batch's vectors as (rows, parts, width of a part), padded with zeros."""
    x = b.column("x")
    flat, lengths = x.flatten().to_numpy(zero_copy_only=False), x.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(x), parts, -1)
    out = np.zeros((len(x), width), np.int32)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out.reshape(len(x), parts, -1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


def _known(b: pa.RecordBatch, parts: int, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = b.num_rows
    if "codes" not in b.schema.names:
        return np.zeros((n, parts), np.int64), *_bounds(None, n, parts, n_groups)
    codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), "<u2").reshape(n, parts).astype(np.int64)
    return codes, *_bounds(b.column("bounds").to_pylist(), n, parts, n_groups)


def _round(rows: DataFrame, books: Codebooks, width: int, label: DataType) -> DataFrame:
    """One pass: rows with new codes and bounds, and per task one row of sums (entry by entry: its parts' sums, then their count)."""
    parts, n_entries, w = books.entries.shape
    kind = StructType([StructField("id", LongType()), StructField("label", label), StructField("x", ArrayType(IntegerType())), StructField("codes", BinaryType()), StructField("bounds", BinaryType()), StructField("sums", ArrayType(LongType()))])
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, n_entries, w + 1), np.int64)
        label_kind = None
        for b in _cut(batches):
            x = _cells(b, width, parts)
            codes, upper, lower = _known(b, parts, books.n_groups)
            _assign(x, codes, upper, lower, books)
            for p in range(parts):
                np.add.at(sums[p, :, w], codes[:, p], 1)
                np.add.at(sums[p, :, :w], codes[:, p], x[:, p])
            bounds = np.concatenate([upper[:, :, None] * _WIDER, lower * _NARROWER], axis=2).astype("<f4")
            label_kind = b.column("label").type
            size = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"), b.column("label"), pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * width, x.reshape(-1)),
                    pa.array([r.tobytes() for r in codes.astype("<u2")], pa.binary()), pa.array([r.tobytes() for r in bounds], pa.binary()),
                    pa.nulls(size, pa.list_(pa.int64())),
                ],
                names=names,
            )
        if label_kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, label_kind), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([sums.reshape(-1)], pa.list_(pa.int64()))], names=names)

    return store(rows.mapInArrow(run, kind), "yinyang")


def _totals(table: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of all tasks; only the column of sums is read."""
    parts, n_entries, w = books.entries.shape
    found = table.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(parts * n_entries * (w + 1), np.int64)
    for r in found:
        flat[r["at"]] = r["n"]
    cube = flat.reshape(parts, n_entries, w + 1)
    return cube[:, :, :w], cube[:, :, w]


def _coded(rows: DataFrame, books: Codebooks, width: int, label: DataType) -> DataFrame:
    """The last assignment: id, label, code and error."""
    parts = len(books.entries)
    digits = max(2, -(-(books.entries.shape[1] - 1).bit_length() // 4))
    kind = StructType([StructField("id", LongType()), StructField("label", label), StructField("code", StringType()), StructField("error", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut(batches):
            x = _cells(b, width, parts)
            codes, upper, lower = _known(b, parts, books.n_groups)
            _assign(x, codes, upper, lower, books)
            error = np.zeros(b.num_rows, np.int64)
            for p in range(parts):
                gap = x[:, p].astype(np.int64) - books.entries[p][codes[:, p]]
                error += (gap * gap).sum(axis=1)
            text = ["".join(f"{k:0{digits}x}" for k in r) for r in codes.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(text, pa.string()), pa.array(error)], names=kind.names)

    return store(rows.mapInArrow(run, kind), "codes")


def whole_numbers(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """id, label, x and its length n of the vectors that take part; x as floor(scale * component)."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    top = F.lit(float(HUGE))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * scale, top), -top)).cast("int"))
    kept = vectors.where(F.col(vector).isNotNull() & finite)
    return kept.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), x.alias("x")).withColumn("n", F.size("x"))


def train_and_code(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, n_groups: int = GROUPS,
) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error) per vector that takes part, and the codebooks; None where no vector has an id and a component."""
    kind = vectors.schema[label].dataType
    rows = store(whole_numbers(vectors, key, vector, label, scale), "vectors")
    longest = rows.agg(F.max("n")).first()[0] or 0
    seeds = [r.x for r in rows.where("id is not null").orderBy("id", "x").limit(entries).select("x").collect()]
    if not seeds or not longest:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    width = -(-longest // parts) * parts
    books = start(np.asarray([[*s, *[0] * (width - len(s))] for s in seeds], np.int64), parts, n_groups)
    rows = rows.select("id", "label", "x")
    for _ in range(rounds):
        table = _round(rows, books, width, kind)
        books = moved(books, *_totals(table, books))
        rows = table.where("x is not null").drop("sums")
    return _coded(rows, books, width, kind), books


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **how: int) -> DataFrame:
    """Per vector: id, label, code, error, label_error (error summed over equal labels, nulls together) and codebooks_sha256."""
    coded, books = train_and_code(vectors, key, vector, label, **how)
    # one row per label, counted before it is joined
    by_label = store(coded.groupBy("label").agg(F.sum("error").cast("long").alias("label_error")), "labels")
    right = by_label.withColumnRenamed("label", "of_label")
    met = coded.join(right, F.col("label").eqNullSafe(F.col("of_label")))
    digest = books.sha256 if books else hashlib.sha256(b"").hexdigest()
    return met.select(F.col("id").alias(key), "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
