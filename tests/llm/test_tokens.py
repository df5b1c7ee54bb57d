"""Token counts, encoding and packing against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparquill.llm import packing, tiktoken_codec, token_cache
from sparquill.llm.queries import vocabulary

PT = pytest.importorskip("public_tokenizers")
WORDS = vocabulary("word_bpe_49k.json")
BYTES = vocabulary("byte_bpe_50k.json")
RANKS = vocabulary("byte_bpe_multi_50k.tiktoken")
texts = st.text(alphabet=st.sampled_from(list("abcXYZéß'.,!? \n\t\x1c\xa0 中文1½<|endoftext|>")), max_size=120)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_counts_equal_the_library(text):
    want = len(token_cache.load_tokenizer(BYTES).encode(text, add_special_tokens=False).ids)
    assert token_cache.counter(BYTES)(text) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, max_size=4))
def test_word_ids_equal_the_library(several):
    t = token_cache.load_tokenizer(WORDS)
    want = [np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in several]
    assert list(packing.word_ids(WORDS)([x.encode() for x in several], 3)) == want


def test_word_table_starts_anew_when_full():
    small = packing.WordIds(WORDS, most=5)
    t = token_cache.load_tokenizer(WORDS)
    for x in ("a b c d", "e f g h i j k l", "Zwei, drei."):
        assert next(small([x.encode()])) == np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 20))
def test_pieces_encode_like_the_whole(text, size):
    enc = tiktoken_codec.encoding(RANKS, PT.PATTERN)
    assert "".join(tiktoken_codec.pieces(text, size)) == text
    assert [i for p in tiktoken_codec.encode(text, enc, size) for i in p] == enc.encode_ordinary(text)


def test_encode_decode_rows(odd_docs, no_docs):
    enc = tiktoken_codec.encoding(RANKS, PT.PATTERN)
    want = []
    for r in odd_docs.collect():
        text = r.text or ""
        ids = enc.encode_ordinary(text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in tiktoken_codec.encode_decode(odd_docs, RANKS, PT.PATTERN, piece_chars=1000).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tiktoken_codec.encode_decode(no_docs, RANKS, PT.PATTERN).count() == 0


def test_cache_encodes_only_what_it_lacks(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/cache"
    t = token_cache.load_tokenizer(BYTES)
    want = sorted([(r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in odd_docs.collect()], key=str)
    first = token_cache.count_tokens(odd_docs, BYTES, path)
    assert sorted(map(tuple, first.collect()), key=str) == want
    stored = spark.read.parquet(path).count()
    assert stored == odd_docs.selectExpr("coalesce(text, '')").distinct().count()
    again = token_cache.count_tokens(odd_docs, BYTES, path)
    assert sorted(map(tuple, again.collect()), key=str) == want
    assert spark.read.parquet(path).count() == stored  # nothing new to append
    monkeypatch.setattr(token_cache, "tokenizer_digest", lambda _: "another")
    token_cache.count_tokens(odd_docs, BYTES, path).collect()
    assert spark.read.parquet(path).count() == 2 * stored  # another version misses all
    assert token_cache.count_tokens(no_docs, BYTES).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 6))
def test_best_fit_keeps_bins_within_bounds(lengths, most):
    packer, fill = packing.BestFit(50, most), {}
    for n in lengths:
        b, at = packer.place(n)
        assert at == fill.get(b, 0)
        fill[b] = at + n
        assert fill[b] <= 50 and packer.open <= most
    assert dict(packer.remaining()).items() <= fill.items()


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert p.place(6) == (0, 0)
    assert p.place(7) == (1, 0)
    assert p.place(3) == (1, 7)  # fits both, tighter in 1, which is full then
    assert p.place(8) == (2, 0)
    assert p.place(9) == (3, 0)  # none fits and two are open: bin 2, the fullest, closes
    assert p.place(4) == (0, 6)
    with pytest.raises(ValueError):
        p.place(11)


def _check_packing(rows, docs, capacity):
    t = token_cache.load_tokenizer(WORDS)
    want = []
    for d in docs:
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), capacity):
            part = ids[i : i + capacity]
            want.append((d.doc_id, i // capacity, i, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, WORDS, capacity=64).collect()
    _check_packing(rows, odd_docs.collect(), 64)
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_packing_merges_what_tasks_leave_open(spark):
    rng = random.Random(3)
    rows = [(i, "a " * int(90 * rng.random() ** 3)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = packing.pack_documents(docs, WORDS, capacity=100, open_bins=8, merge_bins=40).collect()
    bins = _check_packing(got, docs.collect(), 100)
    assert bins <= 1.12 * -(-sum(r.length for r in got) // 100)


def test_each_distinct_miss_is_encoded_once(spark, tmp_path):
    """Copies over several tasks and in a partly filled cache, with slots so few that rows share them."""
    rows = [(i, f"text number {i % 7}" if i % 3 else f"a text of its own {i}") for i in range(90)] + [(None, None), (None, ""), (5, "text number 5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    count = token_cache.counter(BYTES)
    for slots in (2, token_cache.SLOTS):
        path = f"file://{tmp_path}/cache-{slots}"
        some = docs.where("doc_id < 20")
        first = token_cache.fill_cache(some, BYTES, path, slots=slots)
        assert first == len({r.text or "" for r in some.collect()})
        distinct = {r.text or "" for r in docs.collect()}
        assert token_cache.fill_cache(docs, BYTES, path, slots=slots) == len(distinct) - first
        assert token_cache.fill_cache(docs, BYTES, path, slots=slots) == 0
        stored = spark.read.parquet(path).collect()
        assert len(stored) == len(distinct)  # none was encoded twice
        assert {bytes(r.content): r.n_tokens for r in stored} == {hashlib.sha256(t.encode()).digest(): count(t) for t in distinct}
    got = token_cache.count_tokens(docs, BYTES, path)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got.collect()) == sorted((i or -1, count(t or "")) for i, t in rows)
