"""Language, toxicity and language-model operators: held-out accuracy, gradients, defined results."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparquill.llm import langid, pseudo_lm, toxicity
from sparquill.llm.common import crc32_of
from sparquill.session import table


def test_language_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs.where(crc32_of("doc_id") % 4 != 2))
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(crc32_of("doc_id") % 4 == 2)
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_language_defined_results(spark, odd_docs, no_docs):
    model = langid.train(odd_docs.where("doc_id is null or doc_id <> 9"))
    assert model.labels == ("de", "en", "fr")
    got = {(r.doc_id): (r.lang_pred, r.score) for r in langid.predict(odd_docs, model).collect()}
    for k in (2, 3, 7, 8):
        assert got[k] == ("und", 0.0)
    assert got[4][0] == "fr" and 0 < got[4][1] <= 1
    assert langid.predict(no_docs, model).count() == 0
    kept = langid.keep_determined(odd_docs, model)
    assert kept.columns == odd_docs.columns and sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, 4, 5, 5, None, 9], key=str)
    empty = langid.train(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, empty).collect()} == {"und"}


def test_ngrams_don_t_depend_on_blocks(monkeypatch):
    text = "Straße über den Fluß 你好"
    count = lambda: np.bincount(np.concatenate(list(langid.ngrams(text))), minlength=langid.BUCKETS)
    whole = count()
    monkeypatch.setattr(langid, "BLOCK", 5)
    assert (count() == whole).all() and whole.sum() == sum(len(text) - n + 1 for n in range(1, 5))


# --- toxicity


def _brute_marginals(emission, transition):
    n = len(emission)
    p, z = np.zeros(n), 0.0
    for y in itertools.product((0, 1), repeat=n):
        s = np.exp(sum(e for e, on in zip(emission, y, strict=True) if on) + sum(transition[a, b] for a, b in zip(y, y[1:], strict=False)))
        z += s
        p += s * np.asarray(y)
    return p / z, np.log(z)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_forward_backward_sums_all_paths(n):
    rng = np.random.default_rng(n)
    transition = rng.normal(size=(2, 2))
    emission = np.zeros((3, toxicity.WINDOW))
    filled = np.zeros((3, toxicity.WINDOW), bool)
    emission[:, :n], filled[:, :n] = rng.normal(size=(3, n)), True
    p, _, _, logz = toxicity.forward_backward(emission, filled, transition)
    for i in range(3):
        want, z = _brute_marginals(emission[i, :n], transition)
        assert np.allclose(p[i, :n], want) and np.isclose(logz[i], z)


def _whole_chain(emission, transition):
    """Marginals and log normaliser of one chain, place by place in log space."""
    n = len(emission)
    node = np.stack([np.zeros(n), emission], axis=1)
    ahead, back = node.copy(), np.zeros((n, 2))
    for t in range(1, n):
        ahead[t] += np.logaddexp(*(ahead[t - 1][:, None] + transition))
    for t in range(n - 2, -1, -1):
        back[t] = np.logaddexp(*(transition + node[t + 1] + back[t + 1]).T)
    z = np.logaddexp(*ahead[-1])
    return np.exp(ahead[:, 1] + back[:, 1] - z), z


@pytest.mark.parametrize("lengths", [[200], [64, 128, 1, 65, 300], [63, 64, 0, 1000], [5, 640]])
def test_a_text_is_one_chain(lengths):
    """Texts longer than a row of WINDOW tokens, one of 200 among them, against the chain place by place."""
    rng = np.random.default_rng(sum(lengths))
    transition = rng.normal(size=(2, 2)) * 2
    at, filled = toxicity.windows(lengths)
    each = [rng.normal(size=n) * 3 for n in lengths]
    emission = np.where(filled, np.concatenate(each)[at], 0.0)
    starts = np.cumsum([0, *lengths])[:-1]
    follows = ~np.isin(at[:, 0], starts)
    p, _, _, logz = toxicity.forward_backward(emission, filled, transition, follows)
    want = [_whole_chain(e, transition) for e in each if len(e)]
    assert np.allclose(p[filled], np.concatenate([m for m, _ in want]))
    begin = np.flatnonzero(~follows)
    assert np.allclose(np.add.reduceat(logz, begin), [z for _, z in want])


def test_expected_transitions_cross_rows():
    rng = np.random.default_rng(3)
    n, transition, h = 150, rng.normal(size=(2, 2)), 1e-5
    at, filled = toxicity.windows([n])
    emission = np.where(filled, rng.normal(size=n)[at], 0.0)
    follows = np.arange(len(at)) > 0
    log_z = lambda t: toxicity.forward_backward(emission, filled, t, follows)[3].sum()
    _, ahead, back, _ = toxicity.forward_backward(emission, filled, transition, follows)
    found = toxicity._pairs(ahead, back, emission, filled, transition, follows)
    for i, j in itertools.product(range(2), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = h
        assert np.isclose(found[i, j], (log_z(transition + d) - log_z(transition - d)) / (2 * h), rtol=1e-4)
    assert np.isclose(found.sum(), n - 1)


def test_tagger_gives_the_whole_texts_marginals():
    model = toxicity.fit(*_made())
    texts = [" ".join(_made(20, seed=k)[0]).split() for k in (5, 6)] + [[], ["villainy"]]
    for words, p in zip(texts, toxicity.Tagger(model)(texts), strict=True):
        own = model.potentials(words)
        emission = np.asarray([o + model.bias + (own[i - 1][1] if i else 0) + (own[i + 1][2] if i + 1 < len(own) else 0) for i, (o, _, _) in enumerate(own)])
        if len(words):
            assert np.allclose(p, _whole_chain(emission, model.transition)[0], atol=1e-6)


def test_toxicity_of_held_out_documents(spark):
    """Precision and recall on labelled rows that never taught."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(crc32_of("doc_id") % 5 != 0))
    held = labels.where((crc32_of("doc_id") % 5 == 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = toxicity.score(docs.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id").select("toxic", "predicted").collect()
    both = sum(r.toxic and r.predicted for r in got)
    assert sum(r.toxic for r in got) >= 50
    assert both >= 0.9 * sum(r.toxic for r in got) and both >= 0.9 * sum(r.predicted for r in got)


def test_an_id_that_repeats_teaches_within_the_bound(spark):
    """Rows of one id are made distinct and bounded; only the model reaches the driver."""
    fine, bad = [f"good{i} words{i % 7} here" for i in range(60)], [f"vile{i % 3} rant{i} more" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(fine)] * 3 + [(1000 + i, t) for i, t in enumerate(bad)] + [(2000, f"copy {i % 40}") for i in range(300)] + [(3, "x" * 60_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(1000 + i, 1) for i in range(60)] + [(2000, 0), (1, 0)], "doc_id long, toxic int")
    kept = [*fine, *bad, *{f"copy {i}" for i in range(40)}]
    same = toxicity.fit(*zip(*[(t, int(t.startswith("vile"))) for t in sorted(kept)], strict=True))
    model = toxicity.train(docs, labels)
    assert model.constant is None
    both = [toxicity.score_texts([t.encode() for t in kept], m, toxicity.Tagger(m)) for m in (model, same)]
    assert [s >= 0.5 for s in both[0]] == [s >= 0.5 for s in both[1]]
    assert toxicity.train(docs, labels, toxic_docs=0).constant == 0.0
    assert toxicity.train(docs, labels.where("false")).constant == 0.0


def test_slots_name_pieces_of_words():
    """Equal pieces get equal numbers whatever words stand beside them; short words lack beginnings."""
    words = ["Straße", "straßen", "a", "你好", "x" * 300, "STRASSE", "\ud800ab"]
    got = toxicity.slots(words)
    assert (got == np.concatenate([toxicity.slots([w]) for w in words])).all()
    assert (got[0, 1:5] == got[1, 1:5]).all() and got[0, 0] != got[1, 0] and got[0, 5] == toxicity.DIM != got[1, 5]
    assert (got[2, 1:7] == toxicity.DIM).all() and (got[:, 0] < toxicity.DIM).all()
    assert toxicity.slots(["abcd"])[0, 7] == toxicity.slots(["zbcd"])[0, 7] != toxicity.slots(["abce"])[0, 7]
    assert toxicity.slots([]).shape == (0, len(toxicity.BEGINNINGS) + 4)


def test_a_million_characters_of_one_token_score():
    model = toxicity.fit(*_made())
    scores = toxicity.score_texts([b"x" * 1_000_000, b"w1 " * 100_000], model, toxicity.Tagger(model))
    assert all(s < 0.5 for s in scores)


def _made(n=160, seed=1):
    rng = np.random.default_rng(seed)
    fine = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for i in range(n):
        words = list(rng.choice(fine, 40))
        bad = i % 3 == 0
        if bad:
            words[int(rng.integers(40))] = str(rng.choice(["scoundrel", "villainy", "villainous"]))
        texts.append(" ".join(words) + ".")
        y.append(int(bad))
    return texts, y


def test_toxic_spans_and_scores():
    model = toxicity.fit(*_made())
    texts, y = _made(90, seed=9)
    scores = toxicity.score_texts([t.encode() for t in texts], model, toxicity.Tagger(model))
    assert [s >= 0.5 for s in scores] == [bool(v) for v in y]
    text = "w1 w2 Scoundrel w3 w4, and a villain w5"
    found = toxicity.spans(text, model)
    assert [text[s:e] for s, e, _ in found][:1] == ["Scoundrel"]


def test_long_texts_score_as_in_one_batch():
    model = toxicity.fit(*_made())
    long = " ".join(_made(40, seed=3)[0] * 30).encode()
    one = toxicity.Tagger(model)
    assert np.isclose(toxicity.score_texts([long], model, one)[0], toxicity.score_texts([b"", long, b"w1"], model, toxicity.Tagger(model, most=50))[1])


def test_toxicity_rows(spark, odd_docs, no_docs):
    texts, y = _made()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, v) for i, v in enumerate(y)], (0, 0), (None, 1), (9999, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(odd_docs, model, offsets=True).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == 0 and r.spans == [] for r in rows)
    assert toxicity.score(no_docs, model).count() == 0
    hit = toxicity.score(docs, model, offsets=True).where("predicted = 1").collect()
    assert {r.doc_id for r in hit} == {i for i, v in enumerate(y) if v}
    assert all(r.spans for r in hit)
    kept = toxicity.keep_clean(docs.withColumn("score", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == len(y) - sum(y)


def test_toxicity_without_both_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score(odd_docs, toxicity.train(odd_docs, none)).collect()} == {(0.0, 0)}
    all_bad = spark.createDataFrame([(1, 1), (9, 1)], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score(odd_docs, toxicity.train(odd_docs, all_bad)).collect()} == {(1.0, 1)}


# --- pseudo-likelihood


def test_gradient_step_equals_differences():
    rng = np.random.default_rng(0)
    net = pseudo_lm.Network(pseudo_lm.Network.fresh().flat.astype(np.float64))
    ids = rng.integers(0, pseudo_lm.VOCABULARY, 12)
    context = pseudo_lm.contexts(ids)
    before = net.flat.copy()
    mean = lambda flat: pseudo_lm.log_probabilities(pseudo_lm.Network(flat), context, ids).mean()
    pseudo_lm.Trainer(net, 1e6, 1e12).step(context, ids)  # so that a step is the gradient
    moved = np.flatnonzero(net.flat != before)
    for at in rng.choice(moved, 30):
        up, down = before.copy(), before.copy()
        up[at] += 1e-4
        down[at] -= 1e-4
        assert np.isclose((mean(up) - mean(down)) / 2e-4, net.flat[at] - before[at], rtol=2e-2, atol=1e-6)


def test_probabilities_sum_to_one():
    net = pseudo_lm.Network.fresh()
    context = np.repeat(np.asarray([[1, 2, 3, 4]]), pseudo_lm.VOCABULARY, axis=0)
    p = pseudo_lm.log_probabilities(net, context, np.arange(pseudo_lm.VOCABULARY))
    assert np.isclose(np.exp(p).sum(), 1.0, atol=1e-4)


def test_windows_reach_across_blocks_and_leave_the_token_out():
    ids = np.arange(10)
    whole = pseudo_lm.contexts(ids)
    assert (np.concatenate([pseudo_lm.contexts(ids, 0, 4), pseudo_lm.contexts(ids, 4, 10)]) == whole).all()
    assert whole[0].tolist() == [pseudo_lm.VOCABULARY, pseudo_lm.VOCABULARY, 1, 2] and whole[5].tolist() == [3, 4, 6, 7]


def test_scores_sum_token_by_token(spark, odd_docs, no_docs):
    words = ["the", "cat", "sat"]
    net = pseudo_lm.Network.fresh()
    rows = {r.doc_id: r for r in pseudo_lm.score(odd_docs, words, net).collect()}
    for r in odd_docs.collect():
        if r.doc_id in (1, 4, 9):
            ids = pseudo_lm._ids(r.text.encode(), pseudo_lm.numbering(words))
            want = pseudo_lm.log_probabilities(net, pseudo_lm.contexts(ids), ids).sum()
            assert rows[r.doc_id].n_tokens == len(ids) and np.isclose(rows[r.doc_id].log_likelihood, want, rtol=1e-4)
    assert (rows[2].n_tokens, rows[2].log_likelihood, rows[2].perplexity) == (0, 0.0, 1.0)
    assert pseudo_lm.score(no_docs, words, net).count() == 0
    assert pseudo_lm.pseudo_likelihood(no_docs).count() == 0


def test_training_prefers_the_corpus(spark):
    rng = np.random.default_rng(2)
    chain = lambda n: " ".join(itertools.chain.from_iterable(rng.choice([("a", "b", "c"), ("d", "e", "f")]) for _ in range(n)))
    docs = spark.createDataFrame([(i, chain(80)) for i in range(120)], "doc_id long, text string")
    words = pseudo_lm.vocabulary(docs)
    net = pseudo_lm.train(docs, words, docs_per_trainer=40)
    test = spark.createDataFrame([(0, chain(80)), (1, " ".join(rng.permutation(chain(80).split())))], "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood / r.n_tokens for r in pseudo_lm.score(test, words, net).collect()}
    assert got[0] > got[1] + 0.3
    fresh = {r.doc_id: r.log_likelihood / r.n_tokens for r in pseudo_lm.score(test, words, pseudo_lm.Network.fresh()).collect()}
    assert got[0] > fresh[0] + 2


def test_every_document_trains_the_language_model(spark):
    """A single document trains the network, whatever its id hashes to and where it has none."""
    for i in [None, *range(4)]:
        docs = spark.createDataFrame([(i, "one two three four five six seven")], "doc_id long, text string")
        net = pseudo_lm.train(docs, ["one", "two"], rounds=1)
        assert not np.array_equal(net.flat, pseudo_lm.Network.fresh().flat)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=12), min_size=1, max_size=8))
def test_every_token_is_a_target_with_its_window_once(texts):
    class Seen:
        rows: list = []

        def step(self, context, ids, weight):
            self.rows += [(*c, i, w) for c, i, w in zip(context.tolist(), ids.tolist(), weight.tolist(), strict=True)]

    seen = Seen()
    seen.rows = []
    times = [1 + i % 3 for i in range(len(texts))]
    assert pseudo_lm._pass(seen, [np.asarray(t, np.uint16).tobytes() for t in texts], times) == sum(n * len(t) for n, t in zip(times, texts, strict=True))
    wanted = [(*c, i, n) for n, t in zip(times, texts, strict=True) for c, i in zip(pseudo_lm.contexts(np.asarray(t)).tolist(), t, strict=True)]
    assert sorted(seen.rows) == sorted(wanted)


def test_places_that_count_twice_weigh_twice():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, pseudo_lm.VOCABULARY, 20)
    context, again = pseudo_lm.contexts(ids), np.r_[np.arange(20), np.arange(7)]
    one, two = (pseudo_lm.Network(pseudo_lm.Network.fresh().flat.astype(np.float64)) for _ in range(2))
    pseudo_lm.Trainer(one, 0.1).step(context[again], ids[again])
    pseudo_lm.Trainer(two, 0.1).step(context, ids, np.r_[np.full(7, 2), np.ones(13, int)])
    assert np.allclose(one.flat, two.flat, atol=1e-5)


def test_training_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), 30))) for i in range(60)] + [(None, "a b c")] * 5 + [(7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = list("abcdefgh")
    nets = [pseudo_lm.train(d, words, docs_per_trainer=10).flat for d in (docs.repartition(7), docs.coalesce(1).orderBy(F.desc("doc_id")))]
    assert np.array_equal(*nets)
    dealt, trainers = pseudo_lm.deal(pseudo_lm.encode(docs, words), docs_per_trainer=10)
    assert trainers == 4 and dealt.count() == 65  # all with a token


def test_one_token_of_a_million_characters(spark):
    docs = spark.createDataFrame([(1, "x" * 1_000_000), (2, "x")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in pseudo_lm.pseudo_likelihood(docs).collect()} == {1: 1, 2: 1}


def test_a_training_step_takes_all_classes_at_once(monkeypatch):
    """Softmax over tokens runs once a step and once a block of scores, not once a class."""
    calls, inner = [], pseudo_lm._softmax
    monkeypatch.setattr(pseudo_lm, "_softmax", lambda x, at: calls.append(len(x)) or inner(x, at))
    ids = np.random.default_rng(3).integers(0, pseudo_lm.VOCABULARY, 500)
    context = pseudo_lm.contexts(ids)
    trainer = pseudo_lm.Trainer(pseudo_lm.Network.fresh(), 0.1)
    for _ in range(2):
        trainer.step(context, ids)
    assert calls == [500] * 4
    calls.clear()
    long, around = np.tile(ids, 20), np.tile(context, (20, 1))
    got = pseudo_lm.log_probabilities(trainer.net, around, long)
    assert len(calls) == 2 * -(-len(long) // pseudo_lm.BATCH)
    assert np.allclose(got[:500], pseudo_lm.log_probabilities(trainer.net, context, ids), rtol=1e-5)
    one = pseudo_lm.Network(trainer.net.flat)
    h = np.tanh(one.embed[context].reshape(500, -1) @ one.into + one.bias)
    x, c = h @ one.klass + one.klass_bias, ids // pseudo_lm.WITHIN
    y = np.einsum("nh,nhw->nw", h, one.within[c]) + one.within_bias[c]
    want = sum(z[np.arange(500), at] - np.log(np.exp(z).sum(axis=1)) for z, at in ((x, c), (y, ids % pseudo_lm.WITHIN)))
    assert np.allclose(got[:500], want, rtol=1e-4)


def test_texts_are_cut_into_tokens_once(spark, odd_docs, monkeypatch):
    """Runs hold all tokens of all rows, each word once; words and numbers come from there, whatever the runs' length."""
    words = ["cat", "la", "the"]
    want = sorted((str(r.doc_id), pseudo_lm._ids((r.text or "").encode(), pseudo_lm.numbering(words)).tobytes()) for r in odd_docs.collect())
    n = {}
    for r in odd_docs.collect():
        for w in pseudo_lm.tokens((r.text or "").encode()):
            n[w] = n.get(w, 0) + 1
    for length in (1, 1 << 19):
        monkeypatch.setattr(pseudo_lm, "RUN", length)
        cut = pseudo_lm.runs(odd_docs.coalesce(1)).persist()
        assert cut.count() == (1 if length > 1 else sum(bool(pseudo_lm.tokens((r.text or "").encode())) for r in odd_docs.collect()))
        assert all(len(set(r.words)) == len(r.words) for r in cut.collect())
        assert sorted((str(r.doc_id), bytes(r.ids)) for r in pseudo_lm.encode_runs(cut, words).collect()) == want
        assert pseudo_lm.frequent(cut) == sorted(n, key=lambda w: (-n[w], w))


def test_a_run_of_more_words_than_two_bytes_count(spark):
    many = [f"w{i}" for i in range((1 << 16) + 5)]
    docs = spark.createDataFrame([(1, " ".join(many)), (2, many[-1])], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: np.frombuffer(r.ids, np.uint16) for r in pseudo_lm.encode(docs, many[::-1][:100]).collect()}
    assert got[2].tolist() == [0] and len(got[1]) == len(many) and got[1][-100:].tolist() == list(range(99, -1, -1))


def test_scores_take_each_class_of_a_block_in_few_products(monkeypatch):
    """A class of a block is one product, cut only where a step of BATCH places ends."""
    parts, inner = [], pseudo_lm._tokens
    monkeypatch.setattr(pseudo_lm, "_tokens", lambda net, h, own, x: parts.append(len(own)) or inner(net, h, own, x))
    ids = np.random.default_rng(5).integers(0, pseudo_lm.VOCABULARY, 5 * pseudo_lm.BATCH)
    net = pseudo_lm.Network.fresh()
    got = pseudo_lm.log_probabilities(net, pseudo_lm.contexts(ids), ids)
    assert sum(parts) < pseudo_lm.CLASSES + len(parts)
    some = np.arange(0, len(ids), 997)
    assert np.allclose(got[some], pseudo_lm.log_probabilities(net, pseudo_lm.contexts(ids)[some], ids[some]), rtol=1e-5)


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text(st.sampled_from("aZé_9 \n\x1c\x85 .,!«»\x00你—'")) | st.text(st.characters(categories=["So", "Po"]), min_size=150))
def test_marks_set_apart_are_the_pattern_s_tokens(text):
    raw = text.encode("utf-8", "replace")
    assert pseudo_lm.tokens(raw) == pseudo_lm.TOKEN.findall(raw.decode("utf-8", "replace").lower())


def test_words_are_numbered_in_an_array_as_one_by_one():
    own, words = ["b", "été", "a"], ["a", "x", "été", "你好", "b", ""]
    got = pseudo_lm._numbers(pa.array(words), pa.array(own))
    assert got.dtype == np.uint16 and got.tolist() == [pseudo_lm.numbering(own)[w] for w in words]
