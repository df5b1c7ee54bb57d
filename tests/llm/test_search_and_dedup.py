"""Exact top-k, SimHash links and components against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparquill.llm import simhash, topk
from sparquill.llm.components import components


def _brute(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        v = min(w for i, w in good if i == q)
        scored = sorted([(-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q])[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return out


def _frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string").repartition(parts)


def _top(df, k=10, **kw):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k, **kw).collect())


@pytest.mark.parametrize("query_block", [2, 100])
def test_top_k_equals_brute_force(spark, query_block):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[100][1]) for i in range(40)]  # ties by the dozen
    rows += [(None, rows[0][1]), (2001, None), (2002, [None] * 8), (2003, [float("nan")] * 8), (2004, [float("inf")] + [0.0] * 7), (2005, []), (2006, [1.0]), (300, rows[300][1])]
    assert _top(_frame(spark, rows), query_block=query_block, block=64, seed_rows=50) == sorted(_brute(rows, 10))


def test_top_k_with_few_rows_and_none(spark):
    rows = [(0, [1.0, -1.0]), (1, [-1.0, 1.0]), (2, [0.0, 0.0])]
    assert _top(_frame(spark, rows)) == [(0, 1, 2, 0), (0, 2, 1, -2 * 1024 * 1024)]
    assert _top(_frame(spark, [(0, [1.0])])) == []
    assert _top(_frame(spark, [(1, [1.0]), (2, [1.0])])) == []
    assert _top(_frame(spark, rows).where("false")) == []


def test_top_k_stays_exact_beyond_doubles(spark):
    big = 2.0e6  # scaled 2e9, products beyond 2^53
    rows = [(0, [big, 1.0]), (1, [big, 0.0]), (2, [big, 1.0]), (3, [1e30, 0.0]), (4, [1e31, 0.0])]
    got = _top(_frame(spark, rows))
    a = math.floor(1024 * big)
    assert got == [(0, 1, 3, 2**63 - 1), (0, 2, 4, 2**63 - 1), (0, 3, 2, a * a + 1024 * 1024), (0, 4, 1, a * a)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 5), min_size=3, max_size=3), min_size=1, max_size=30), st.lists(st.integers(-5, 5), min_size=3, max_size=3), st.integers(-30, 40))
def test_a_block_gives_every_row_at_or_above_the_threshold(rows, query, threshold):
    x, q = np.asarray(rows, float), np.asarray(query, float)
    at, scores = topk.search_block(topk.Lists(x), q, threshold)
    exact = x @ q
    assert set(np.flatnonzero(exact >= threshold)) <= set(at.tolist())
    assert all(exact[i] == s for i, s in zip(at, scores, strict=True))


# --- SimHash


def _reference_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abAÉé \t\n\x0b\xa0.")), max_size=60))
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == _reference_fingerprint(text)


def _roots(values, radius=3):
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    vs = sorted(up)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                a2, b2 = find(a), find(b)
                up[max(a2, b2)] = min(a2, b2)
    return {v: find(v) for v in vs}


def _clusters(rng, n_centres, n_each, bits):
    out = set()
    for _ in range(n_centres):
        c = int(rng.integers(0, 1 << 63))
        for _ in range(n_each):
            v = c
            for b in rng.choice(64, int(rng.integers(0, bits + 1)), replace=False):
                v ^= 1 << int(b)
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize("heavy", [1024, 5])
def test_links_connect_what_brute_force_connects(spark, heavy, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    values = _clusters(np.random.default_rng(heavy), 12, 40, 4)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components(simhash.link(df, heavy=heavy)).collect()}
    want = _roots(values)
    mine: dict = {}
    for v in values:
        mine.setdefault(got.get(v, v), set()).add(v)
    theirs: dict = {}
    for v in values:
        theirs.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([100, 10**5, 10**8]))
def test_masks_cover_every_pair_within_the_radius(seed, n):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    fps[:, None]
    chosen = simhash.masks(fps, n)
    for _ in range(300):
        d = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(m & d == 0 for m in chosen)


def test_thresholds_are_unequal_where_that_is_cheaper():
    cheap, dear = [0.0, 1.0, 2.0, 3.0], [0.0, 50.0, 500.0, 5000.0]
    assert simhash.allocate([cheap, dear], 1) == (3.0, [2, -1])
    assert simhash.allocate([cheap, cheap], 1)[0] == 3.0


def test_near_duplicates_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    docs = odd_docs.collect()
    fp = {r.text: _reference_fingerprint(r.text or "") for r in docs}
    roots = _roots(set(fp.values()))
    ids = {}
    for r in docs:
        if r.doc_id is not None:
            k = roots[fp[r.text]]
            ids[k] = min(ids.get(k, r.doc_id), r.doc_id)
    want = sorted([(r.doc_id, f"{fp[r.text]:016x}", ids.get(roots[fp[r.text]])) for r in docs], key=str)
    assert sorted(map(tuple, rows), key=str) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_row_of_each_group_stays(spark, odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted([r.doc_id for r in kept.collect()], key=str)
    assert ids == sorted([1, 2, 4, None, 8, 9], key=str)  # 5 repeats 1; 3 and 7 have no words, as 2
    assert simhash.keep_one(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "other words entirely here")], "doc_id long, text string")
    assert simhash.keep_one(twice).count() == 2


def test_similar_texts_beyond_the_radius_go_too(spark):
    """Near copies of 0.8 and more go, whatever their fingerprints' distance; less similar texts stay."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, fate = [], {}
    for base in range(0, 400, 10):
        words = [word() for _ in range(200)]
        rows.append((base, " ".join(words)))
        for i, edits in enumerate((1, 2, 4, 30), 1):
            copy = list(words)
            for at in rng.choice(range(2, 198), edits, replace=False):
                copy[at] = word()
            rows.append((base + i, " ".join(copy)))
    sets = {i: np.frombuffer(simhash.shingle_set(t.encode(), 5), np.uint32) for i, t in rows}
    for base in range(0, 400, 10):
        for i in range(1, 5):
            fate[base + i] = simhash.jaccard(sets[base].tobytes(), sets[base + i].tobytes()) >= 0.8
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {b for b in range(0, 400, 10)} <= kept
    missed = [i for i, gone in fate.items() if gone and i in kept]
    assert sum(fate.values()) >= 100 and len(missed) <= 0.02 * sum(fate.values())
    assert all(i in kept for i in fate if i % 10 == 4)


def test_masks_of_a_wide_radius_cover_its_pairs():
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for n in (10**3, 10**6):
        chosen = simhash.masks(fps, n, 8)
        for _ in range(500):
            d = sum(1 << int(b) for b in rng.choice(64, 8, replace=False))
            assert any(m & d == 0 for m in chosen)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 160))
def test_pairs_in_groups_are_the_nearest_of_other_classes(seed, n):
    rng = np.random.default_rng(seed)
    group = np.sort(rng.integers(0, 3, n))
    fp, other = (rng.integers(0, 1 << 5, n, dtype=np.uint64) for _ in range(2))
    root, told = rng.integers(0, 6, n), np.arange(n)
    want = set()
    for i in range(n):
        near = []
        for j in range(n):
            d, e = bin(int(other[i] ^ other[j])).count("1"), bin(int(fp[i] ^ fp[j])).count("1")
            if group[i] == group[j] and root[i] != root[j] and e <= 2 and d <= 2:
                near.append((d + e, j))
        for _, j in sorted(near)[:2]:
            x, y = (i, j) if root[i] < root[j] else (j, i)
            want.add((int(root[x]), int(root[y]), x, y))
    got = simhash.pairs_in_groups(group, fp, other, root, told, 2, 2, 2)
    assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{j: 100 for j in range(100, 160)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _edited(rng, kind, words, fresh):
    """A copy with a block added, removed, cut off at the end, or with words replaced."""
    n = len(words)
    cut = max(1, int(n * rng.uniform(0.02, 0.25)))
    at = int(rng.integers(0, n))
    if kind == "added":
        return words[:at] + [fresh() for _ in range(cut)] + words[at:]
    if kind == "removed":
        return words[:at] + words[at + cut :]
    if kind == "cut":
        return words[: n - cut]
    out = list(words)
    for i in rng.choice(n, max(1, cut // 6), replace=False):
        out[i] = fresh()
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(["added", "removed", "cut", "words"]), st.sampled_from([6, 9, 20, 60, 200, 1500]))
def test_similar_sets_share_a_key_whatever_the_edit(seed, kind, n):
    rng = np.random.default_rng(seed)
    fresh = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    words = [fresh() for _ in range(n)]
    a, b = (np.frombuffer(simhash.shingle_set(" ".join(w).encode(), 5), np.uint32) for w in (words, _edited(rng, kind, words, fresh)))
    if simhash.jaccard(a.tobytes(), b.tobytes()) >= 0.8:
        assert len(np.intersect1d(simhash.set_keys(a, 0.8), simhash.set_keys(b, 0.8)))


def test_every_similar_pair_of_small_sets_shares_a_key():
    rng = np.random.default_rng(3)
    pool = np.sort(rng.choice(1 << 32, 400, replace=False).astype(np.uint32))
    similar = 0
    for _ in range(3000):
        n = int(rng.integers(1, 40))
        a = set(rng.choice(400, n, replace=False).tolist())
        b = set(a) - set(rng.choice(sorted(a), min(len(a) - 1, int(rng.integers(0, 5))), replace=False).tolist()) | set(rng.choice(400, int(rng.integers(0, 5))).tolist())
        if len(a & b) >= 0.8 * len(a | b):
            similar += 1
            assert len(np.intersect1d(simhash.set_keys(pool[sorted(a)], 0.8), simhash.set_keys(pool[sorted(b)], 0.8)))
    assert similar > 500


def _survivors(rows):
    """Documents that brute force keeps: components of similarity 0.8 on texts or three bits, the smallest id of each."""
    sets = {i: simhash.shingle_set(t.encode(), 5) for i, t in rows}
    fps = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    joined = simhash._Sets()
    for a in sets:
        for b in sets:
            if a < b and (simhash.jaccard(sets[a], sets[b]) >= 0.8 or (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS):
                joined.join(a, b)
    return {joined.find(i) for i in sets}


def test_block_edits_and_short_texts_are_found(spark):
    """A block added or removed moves distinct words as much as shingles, beyond eight bits of a fingerprint."""
    rng = np.random.default_rng(8)
    fresh = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for base, kind in enumerate(["added", "removed", "cut", "words"] * 15):
        words = [fresh() for _ in range(int(rng.choice([12, 25, 60, 200])))]
        rows += [(base * 10, " ".join(words)), (base * 10 + 1, " ".join(_edited(rng, kind, words, fresh)))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == _survivors(rows)


def test_a_dense_group_is_joined_past_the_nearest(spark):
    """Texts with many closer-looking neighbours of other classes that fail are still compared with all the rest."""
    rng = np.random.default_rng(9)
    fresh = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    shared = [fresh() for _ in range(150)]
    rows = []
    for i in range(40):
        own = [fresh() for _ in range(24)]
        rows.append((i * 10, " ".join(shared + own)))
        if i % 4 == 0:
            rows.append((i * 10 + 1, " ".join([fresh() for _ in range(20)] + shared + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert kept == _survivors(rows)


def test_parities_rule_out_no_similar_pair():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32))
        b = np.unique(np.r_[a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 1 << 32, int(rng.integers(0, 1 + n // 5)), dtype=np.uint32)])
        if len(b) and simhash.jaccard(a.tobytes(), b.tobytes()) >= 0.8:
            sketch = np.stack([simhash.parities(a), simhash.parities(b)], axis=1)
            assert simhash.may_be_similar(np.asarray([len(a), len(b)]), sketch, np.asarray([0]), np.asarray([1]), 0.8).all()


def test_keys_of_the_same_texts_are_one_group(spark):
    rows = [(k, t) for k in (1, 2, 3) for t in range(2000)] + [(4, t) for t in range(1999)] + [(5, 7), (5, 7), (6, 1), (6, 2), (6, 2)]
    got = simhash.same_large_keys(spark.createDataFrame(rows, "key long, told long").repartition(7)).collect()
    sets, want = {}, {}
    for k, t in set(rows):
        sets.setdefault(k, set()).add(t)
    for s in sets.values():
        if len(s) > 1:
            want[frozenset(s)] = want.get(frozenset(s), 0) + 1
    found = {}
    for r in got:
        found.setdefault(r.key, []).append((r.told, r["keys"]))
    assert {frozenset(t for t, _ in v): v[0][1] for v in found.values()} == want and sum(map(len, found.values())) == sum(map(len, want))
    assert simhash.same_large_keys(spark.createDataFrame([], "key long, told long")).count() == 0


def test_a_group_over_many_batches_is_held_whole():
    import pyarrow as pa

    made = [[(1, 0, 0, 5)] * 3, [(1, 0, 0, 6)], [], [(1, 0, 0, 7), (2, 0, 0, 8)], [(2, 0, 0, 9)], [(3, 0, 0, 1)]]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in b], pa.int64()) for i in range(4)], names=["a", "b", "c", "d"]) for b in made]
    whole = lambda group, c: np.stack([group.astype(np.uint64), c[0]], axis=1)
    got = [b.to_pydict() for b in simhash._in_groups(whole, ["g", "v"])(iter(batches))]
    runs = {}
    for n, b in enumerate(got):
        for g, v in zip(b["g"], b["v"], strict=True):
            runs.setdefault((n, g), []).append(v)
    assert list(runs.values()) == [[5, 5, 5, 6, 7], [8, 9], [1]]


def test_large_keys_give_the_groups_of_small_ones(spark):
    """The two ways of grouping keys agree, whatever the threshold."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(60)] + [(100 + i, " ".join(f"y{i}z{j}" for j in range(30))) for i in range(20)]
    texts = spark.createDataFrame(rows, "doc_id long, t string").select("doc_id", F.xxhash64("t").alias("told"), F.col("t").cast("binary").alias("t"))

    def sets(large, one_in):
        found = {}
        for r in simhash.shared_keys(texts, 0.8, 5, large, one_in).collect():
            found.setdefault(r.key, []).append((r.told, r["keys"]))
        return sorted((sorted(t for t, _ in v), v[0][1]) for v in found.values())

    assert sets(1 << 16, 64) == sets(4, 1) == sets(40, 2) != []


def test_candidates_grow_with_pairs_and_not_with_their_keys(spark, monkeypatch):
    """Long texts of a family share hundreds of keys, in any number of tasks; a pair is a candidate a few times."""
    rng = np.random.default_rng(6)
    fresh = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    shared, rows = [fresh() for _ in range(1500)], []
    for i in range(16):
        words = list(shared)
        for at in rng.choice(1500, 20 + i, replace=False):
            words[at] = fresh()
        rows.append((i, " ".join(words)))
    made, inner = spark.sparkContext.accumulator(0), simhash._in_groups

    def counting(search, names):
        run = inner(search, names)

        def counted(batches):
            for b in run(batches):
                made.add(b.num_rows)
                yield b

        return counted if len(names) > 3 else run

    monkeypatch.setattr(simhash, "_in_groups", counting)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert kept == _survivors(rows)
    assert 0 < made.value <= 3 * math.comb(len(rows), 2)


@pytest.mark.parametrize("part", [2048, 4])
def test_pairs_that_share_enough_keys_meet(spark, part, monkeypatch):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "DENSE", part)
    rng = np.random.default_rng(part)
    keys = {t: set(rng.choice(120, int(rng.integers(1, 60)), replace=False).tolist()) for t in range(60)}
    times = rng.integers(1, 4, 120).tolist()
    least = {t: int(rng.integers(1, 30)) for t in keys}
    root = {t: int(rng.integers(0, 20)) for t in keys}
    columns = ["key", "told", "keys", "root", "fp", "n", "least", *simhash._PARITIES]
    rows = [(1000 + k, t, times[k], root[t], t, 100, least[t], *[0] * simhash.SKETCH) for t, own in keys.items() for k in own]
    ordered = simhash.in_order(spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns)))
    found = {(min(r.x, r.y), max(r.x, r.y)) for r in simhash.pairs_met(ordered, 0.8, 0).collect()}
    share = {(x, y): sum(times[k] for k in keys[x] & keys[y]) for x in keys for y in keys if x < y and root[x] != root[y]}
    enough = {p for p, n in share.items() if n >= min(least[p[0]], least[p[1]])}
    assert enough <= found <= {p for p, n in share.items() if n} and len(enough) > 100
