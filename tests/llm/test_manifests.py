"""Numbering, shards, the Merkle manifest and vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparquill.llm import merkle, numbering, sharding, vector_codes


def _first(v):
    return (v is not None, v if v is not None else 0)


def test_rows_are_numbered_within_groups_of_any_size(spark):
    rows = [("a" if i % 3 else "b", i % 7, i % 5) for i in range(400)] + [("c", 1, 1)] * 300 + [("d", 0, 9)]
    found = numbering.number_rows(spark.createDataFrame(rows, "g string, k int, w long").repartition(5), ["g", "k"], "g", "w").collect()
    by = defaultdict(list)
    for r in found:
        by[r.g].append(r)
    assert Counter((r.g, r.k, r.w) for r in found) == Counter(rows)
    for group in by.values():
        group.sort(key=lambda r: r["at"])
        assert [r["at"] for r in group] == list(range(len(group))) and [r.k for r in group] == sorted(r.k for r in group)
        ahead = 0
        for r in group:
            assert (r.before, r.n_rows, r.total) == (ahead, len(group), sum(x.w for x in group))
            ahead += r.w


def _shards(docs, n):
    rows = sorted(((r.doc_id, len(d := (r.text or "").encode()) + 16, zlib.crc32(d)) for r in docs), key=lambda r: (_first(r[0]), r[1:]))
    total, ahead, out, used = sum(r[1] for r in rows), 0, [], Counter()
    for key, size, crc in rows:
        shard = min((2 * ahead + size) * n // (2 * total), n - 1)
        out.append((key, size, crc, shard, used[shard]))
        used[shard] += 1
        ahead += size
    return Counter(out)


def test_shards(spark, odd_docs, no_docs):
    docs = odd_docs.repartition(3)
    found = sharding.assign_shards(docs, 4)
    assert Counter(tuple(r) for r in found.collect()) == _shards(docs.collect(), 4)
    assert found.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    same = spark.createDataFrame([(1, "copy of one text")] * 500 + [(None, None)] * 20, "doc_id long, text string")
    got = Counter()
    for r in sharding.assign_shards(same, 10).collect():
        got[r.shard] += r["size"]
    assert max(got.values()) - min(got.values()) <= 32 and len(got) == 10 and sum(got.values()) == 520 * 16 + 500 * 16
    assert sharding.assign_shards(no_docs).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, 0)


def test_shards_near_equal_on_a_table(spark, sf_dir):
    rows = entry.queries()["op11_prefix_shards"](spark, sf_dir).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    target, largest = sum(sizes.values()) / 40, max(r.size for r in rows)
    assert all(abs(s - target) <= largest for s in sizes.values())


def test_shards_are_written_in_order(spark, odd_docs, tmp_path):
    sharding.write_shards(odd_docs.repartition(3), f"file://{tmp_path}/s", 3, keep=["lang"])
    got = spark.read.parquet(f"file://{tmp_path}/s").collect()
    assert Counter((r.doc_id, r.text, r.lang) for r in got) == Counter((r.doc_id, r.text, r.lang) for r in odd_docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == _shards(odd_docs.collect(), 3)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(leaves, fan):
    """(root, proofs) of a list of hex digests."""
    proofs, members = [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        up, groups = [], []
        for at in range(0, len(leaves), fan):
            run = leaves[at : at + fan]
            for j in range(len(run)):
                for i in members[at + j]:
                    proofs[i] += run[:j] + run[j + 1 :]
            up.append(_sha("".join(run)))
            groups.append([i for m in members[at : at + fan] for i in m])
        leaves, members = up, groups
    return leaves[0], proofs


def _leaf(r, more=0):
    n = r.n_chars + more if r.n_chars is not None else None
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)))


def _manifest(docs, fan=2):
    by = defaultdict(list)
    for r in docs:
        by[r.lang].append(r)
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (_first(r.doc_id), _leaf(r)))
        trees[lang] = _tree([_leaf(r) for r in by[lang]], fan)
    root, tops = _tree([trees[v][0] for v in langs], fan)
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for r, path in zip(by[lang], trees[lang][1], strict=True):
            out.append((r, _leaf(r), trees[lang][0], root, "".join(path + top)))
    return out


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, f"s{i % 3}" if i % 5 else None, None if i % 11 == 0 else "den"[i % 3] * 2, None if i % 13 == 0 else i, f"täxt {i % 17}", 1) for i in range(90)]
    rows += [(3, "again", "zz", 1, "x", 1), (3, "again", "zz", 1, "x", 1), (None, None, "one", (1 << 63) - 1, None, 1), (None, None, None, None, "", 1), (7, "s", "Zz", (1 << 63) - 1, "y" * 300_000, 1)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, g int").repartition(4)


@pytest.mark.parametrize("fan", [2, 3])
def test_manifest(records, fan):
    want = Counter((r.doc_id, leaf, sub, root, proof, root) for r, leaf, sub, root, proof in _manifest(records.collect(), fan))
    assert Counter(tuple(r) for r in merkle.manifest(records, fan=fan).collect()) == want


def test_tampering_is_found(records):
    altered = lambda r: r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
    found = merkle.manifest(records, tampered=merkle.one_more_char()).collect()
    good = Counter(r.doc_id for r in found if r.folded_root == r.root)
    assert good == Counter(r.doc_id for r in records.collect() if not altered(r))
    assert any(altered(r) for r in records.collect())


def test_small_manifests(spark, records, odd_docs):
    assert merkle.manifest(records.where("false")).count() == 0
    one = records.where("lang = 'one'")
    (r,) = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof == ""
    two = records.where("lang in ('one', 'zz')")
    assert {r.folded_root for r in merkle.manifest(two).collect()} == {merkle.manifest(two).first().root}


def test_a_stage_of_levels_shares_one_shuffle(spark):
    below = F.array(F.struct(F.struct("id").alias("row"), F.lit(b"").alias("path"))).alias("below")
    nodes = spark.range(64).select(F.col("id").cast("string").alias("g"), F.col("id").alias("idx"), F.lit(64).cast("long").alias("c"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("h"), below)
    plan = nodes.withColumn("block", F.expr("idx div 64")).repartition("g", "block")
    for _ in range(3):
        plan = merkle._level(plan, 2)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def _codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Plain Lloyd in Python integers: {row number: (code, error)} and the codebooks."""
    whole = [[max(-vector_codes.HUGE, min(vector_codes.HUGE, math.floor(scale * x))) for x in v] for _, v in rows]
    width = -(-max(map(len, whole)) // parts) * parts
    whole = [v + [0] * (width - len(v)) for v in whole]
    w = width // parts
    seeds = [v for _, v in sorted((i, v) for (i, _), v in zip(rows, whole, strict=True) if i is not None)][:entries]
    books = [[s[p * w : (p + 1) * w] for s in seeds] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            met = defaultdict(list)
            for v in whole:
                x = v[p * w : (p + 1) * w]
                met[near(x, books[p])[1]].append(x)
            for k, xs in met.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for v in whole:
        best = [near(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        out.append(("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def _check_codes(spark, rows, **how):
    """rows: (id, vector, label)"""
    made = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, n int").repartition(3)
    got = vector_codes.compress(made, **how).collect()
    usable = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want, digest = _codes([(i, v) for i, v, _ in usable], **how)
    by_label = Counter()
    for (_, _, lab), (_, error) in zip(usable, want, strict=True):
        by_label[lab] += error
    assert Counter(tuple(r) for r in got) == Counter((i, lab, code, error, by_label[lab], digest) for (i, _, lab), (code, error) in zip(usable, want, strict=True))


def test_codes_equal_plain_lloyd(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 16))
    rows = [(int(i), [float(x) for x in centres[i % 9] + rng.normal(size=16) * 0.3], int(i % 4) if i % 10 else None) for i in rng.permutation(300)]
    _check_codes(spark, rows)


def test_codes_of_odd_vectors(spark):
    rows = [(i, [float(i % 3), -1.0, 0.5, 0.0], i % 2) for i in range(40)]  # ties and copies everywhere, one component a part and less
    rows += [(100, None, 1), (101, [1.0, None], 1), (102, [float("nan")] * 4, 1), (103, [float("inf")], 0), (104, [1e30, -1e30, 3.0], None), (None, [2.0] * 4, None), (None, [-9.0] * 9, 7), (5, [0.1], 3), (106, [], 2)]
    _check_codes(spark, rows)
    few = [(3, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [5.0, -2.0], 0)]
    _check_codes(spark, few)
    made = spark.createDataFrame([(*r, "x") for r in few], "vec_id long, embedding array<double>, label string, bounds string")
    assert vector_codes.compress(made.where("false")).count() == 0
    assert vector_codes.compress(made.withColumn("embedding", made.embedding.cast("array<float>"))).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 16), st.sampled_from([3, 50, 4000, 1 << 25]))
def test_bounds_never_hide_a_nearer_entry(seed, n, k, size):
    rng = np.random.default_rng(seed)
    x = rng.integers(-size, size + 1, (n, 1, 4)).astype(np.int32)
    books = vector_codes.start(rng.integers(-size, size + 1, (k, 4)), 1, 4)
    codes, (upper, lower) = np.zeros((n, 1), np.int64), vector_codes._bounds(None, n, 1, 4)
    for _ in range(5):
        vector_codes._assign(x, codes, upper, lower, books)
        d = vector_codes.squared(x[:, 0], books.entries[0])
        assert (codes[:, 0] == d.argmin(axis=1)).all()
        sums, counts = np.zeros((1, k, 4), np.int64), np.zeros((1, k), np.int64)
        np.add.at(sums[0], codes[:, 0], x[:, 0])
        np.add.at(counts[0], codes[:, 0], 1)
        books = vector_codes.moved(books, sums, counts)
        if rng.random() < 0.3:  # bounds as they are stored
            both = np.concatenate([upper[:, :, None] * vector_codes._WIDER, lower * vector_codes._NARROWER], axis=2).astype("<f4")
            upper, lower = vector_codes._bounds([r.tobytes() for r in both], n, 1, 4)


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = (centres[rng.integers(0, 16, 5000)] + rng.integers(-200, 200, (5000, 8))).astype(np.int32)
    books = vector_codes.start(centres + 30, 1, 4)
    code, upper, lower = np.zeros(5000, np.int64), np.full(5000, np.inf), np.zeros((5000, 4))
    first = vector_codes.assign_part(x, code, upper, lower, books.entries[0], books.groups[0], books.drift[0])
    sums, counts = np.zeros((1, 16, 8), np.int64), np.zeros((1, 16), np.int64)
    np.add.at(sums[0], code, x)
    np.add.at(counts[0], code, 1)
    books = vector_codes.moved(books, sums, counts)
    again = vector_codes.assign_part(x, code, upper, lower, books.entries[0], books.groups[0], books.drift[0])
    assert first >= 16 * 5000 and again < first / 4
    assert (code == vector_codes.squared(x, books.entries[0]).argmin(axis=1)).all()


@pytest.mark.parametrize("name", ["op11_prefix_shards", "op12_merkle_manifest", "op13_yinyang_codes"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert compare(entry.queries()[name](spark, sf_dir), entry.oracle_sql()[name], sf_dir) == []
