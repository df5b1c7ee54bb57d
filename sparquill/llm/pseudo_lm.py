"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts every token from the `REACH` tokens before it and the `REACH`
after it, never from itself: embeddings of the window, one tanh layer, then a
softmax in two steps, the token's class and the token within its class. The sum of
the conditional log-probabilities is the document's score.

* runs: every text is cut into tokens once. Some documents together hold their distinct
  words, how often each occurs, and each token's place among those words.
* vocabulary: words of all runs are counted; the most frequent get numbers of their
  own, the rest share hash buckets. A class holds tokens of neighbouring rank.
* encode: a text becomes its tokens' numbers, 2 bytes each, once for training and scoring;
  numbers are looked up once for each distinct word of a run.
* train: every document is dealt, by a hash of id and text, to a round and there to a
  trainer of about `docs_per_trainer` documents. Every token of every whole text is masked
  once. Numbers travel, and not texts. Each trainer, a group of its own, sorted by hash,
  trains a copy in numpy; copies are averaged slice by slice in a tree, weighted by their
  tokens, and the next round starts from there. The result doesn't depend on how rows lie
  in files or tasks.
* score: the parameters, of fixed size, are broadcast and every text is scored whole,
  in blocks of tokens that see their neighbours across block ends.

Defined results: null and empty texts have no tokens, score 0 and perplexity 1; a
corpus without words leaves the network as initialised; repeated rows and null ids
give a row each; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import Batch, ByMiss, map_batches, store, text_bytes

TOKEN = re.compile(r"\w+|[^\w\s]")
CLASSES = WITHIN = 64
VOCABULARY = CLASSES * WITHIN
RARE = 256
REACH = 2
EMBEDDING, HIDDEN = 16, 32
#: About so many documents go to a trainer, and each document to one of the rounds.
DOCS_PER_TRAINER, ROUNDS = 8000, 2
#: Tokens of a step: at most, and so that a trainer makes about so many steps.
BATCH, STEPS = 4096, 128
BLOCK = 1 << 15
#: Tokens after which a run of documents ends.
RUN = 1 << 19
_SLICE = 8192
_FAN = 64

SCHEMA = "doc_id long, n_tokens long, log_likelihood double, perplexity double"


#: ASCII characters that are tokens of their own; a search for the others.
MARKS = [c for c in map(chr, range(128)) if not (c.isalnum() or c.isspace() or c == "_")]
OTHER_MARK = re.compile(r"[^\w\s\x00-\x7f]")


def tokens(raw: bytes) -> list[str]:
    """TOKEN's matches; setting marks apart by spaces takes less time than matching every token."""
    text = raw.decode("utf-8", "replace").lower()
    others = set() if text.isascii() else set(OTHER_MARK.findall(text))
    if len(others) > len(MARKS):
        return TOKEN.findall(text)
    for c in (*MARKS, *others):
        if c in text:
            text = text.replace(c, f" {c} ")
    return text.split()


def _shapes() -> list[tuple[str, tuple[int, ...]]]:
    return [
        ("embed", (VOCABULARY + 1, EMBEDDING)),  # the last row stands for a place outside the text
        ("into", (2 * REACH * EMBEDDING, HIDDEN)),
        ("bias", (HIDDEN,)),
        ("to_klass", (HIDDEN + 1, CLASSES)),  # the last row is the bias, here and below
        ("to_token", (CLASSES, HIDDEN + 1, WITHIN)),
    ]


@dataclass
class Network:
    """All parameters in one vector, with a view per layer."""

    flat: np.ndarray

    def __post_init__(self) -> None:
        at = 0
        for name, shape in _shapes():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n
        self.klass, self.klass_bias = self.to_klass[:HIDDEN], self.to_klass[HIDDEN]
        self.within, self.within_bias = self.to_token[:, :HIDDEN], self.to_token[:, HIDDEN]

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for _, s in _shapes())

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        net = cls(np.zeros(cls.size(), np.float32))
        rng = np.random.default_rng(seed)
        for name in ("embed", "into", "klass", "within"):
            layer = getattr(net, name)
            layer[...] = rng.normal(0.0, 0.1 if name == "embed" else 1.0 / np.sqrt(layer.shape[-2]), layer.shape)
        return net


def contexts(ids: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
    """Window of each place start..end: ids of the places around it, VOCABULARY outside the text."""
    end = len(ids) if end is None else end
    wide = np.full(end - start + 2 * REACH, VOCABULARY, np.int64)
    lo, hi = max(0, start - REACH), min(len(ids), end + REACH)
    wide[lo - start + REACH : hi - start + REACH] = ids[lo:hi]
    n = end - start
    return np.stack([wide[i : i + n] for i in range(2 * REACH + 1) if i != REACH], axis=1)


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-probability of column `at`, exponentials, their sums) of each row; x is used up."""
    if x.size and (top := float(x.max())) > 60.0:  # below that exponentials can't overflow
        x -= top if top - float(x.min()) < 60.0 else x.max(axis=1, keepdims=True)
    picked = x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at]
    np.exp(x, out=x)
    sums = x @ np.ones(x.shape[1], x.dtype)
    return picked - np.log(sums), x, sums


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of the places in which those of a class stand together, and each class with its places there."""
    classes = (ids // WITHIN).astype(np.uint8)
    order = np.argsort(classes, kind="stable")
    ends = np.cumsum(np.bincount(classes, minlength=CLASSES)).tolist()
    return order, [(c, slice(s, e)) for c, (s, e) in enumerate(zip([0, *ends], ends, strict=False)) if s < e]


def _tanh(x: np.ndarray) -> np.ndarray:
    """tanh in place, as 1 - 2 / (exp(2x) + 1), which takes less time than numpy's."""
    x += x
    np.exp(np.minimum(x, 60.0, out=x), out=x)
    x += 1.0
    np.divide(-2.0, x, out=x)
    x += 1.0
    return x


def _hidden(net: Network, x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The tanh layer over embedded windows x, in h, whose last column is one, for the biases after it."""
    layer = x @ net.into
    layer += net.bias
    h[:, :HIDDEN] = _tanh(layer)
    h[:, HIDDEN] = 1.0
    return h


def _tokens(net: Network, h: np.ndarray, parts: list[tuple[int, slice]], x: np.ndarray) -> np.ndarray:
    """Each place's logits of the tokens of its class, in x; places stand by class."""
    for c, own in parts:
        np.dot(h[own], net.to_token[c], out=x[own])
    return x


def log_probabilities(net: Network, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log p(id | window) of each place; so many at a time that their arrays stay in a core's cache.

    All places stand by class, so that those at a time have few classes, each in one product."""
    out = np.empty(len(ids))
    order, parts = _by_class(ids)
    most = min(BATCH, len(ids))
    held_h, held_x = np.empty((most, HIDDEN + 1), net.flat.dtype), np.empty((most, WITHIN), net.flat.dtype)
    for at in range(0, len(ids), BATCH):
        places = order[at : at + BATCH]
        own, end = ids[places], at + len(places)
        here = [(c, slice(max(s.start - at, 0), min(s.stop, end) - at)) for c, s in parts if s.start < end and s.stop > at]
        h = _hidden(net, np.take(net.embed, context[places], axis=0).reshape(len(own), -1), held_h[: len(own)])
        x = np.dot(h, net.to_klass, out=held_x[: len(own)])
        logs = _softmax(x, own // WITHIN)[0].astype(np.float64)
        logs += _softmax(_tokens(net, h, here, x), own % WITHIN)[0]
        out[places] = logs
    return out


class Trainer:
    """AdaGrad steps on one network, with its working arrays."""

    def __init__(self, net: Network, rate: float, start: float = 1e-7):
        self.net, self.rate = net, rate
        self.grad = Network(np.zeros_like(net.flat))
        self.square = np.full_like(net.flat, start)
        self.work = np.empty_like(net.flat)
        self.held: dict[str, np.ndarray] = {}

    def _array(self, name: str, *shape: int) -> np.ndarray:
        """A working array that is kept from step to step, as fresh memory costs more than what is done in it."""
        size = int(np.prod(shape))
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, self.net.flat.dtype)
        return self.held[name][:size].reshape(shape)

    def step(self, context: np.ndarray, ids: np.ndarray, weight: np.ndarray | None = None) -> float:
        """One step on a batch, of places that count `weight` times (once); gives the mean log-likelihood before it."""
        net, grad, n = self.net, self.grad, len(ids)
        order, parts = _by_class(ids)
        context, ids, at = context[order], ids[order], np.arange(0, n * WITHIN, WITHIN)
        times = np.ones(n, np.float32) if weight is None else weight[order].astype(np.float32)
        share = times / times.sum()
        grad.flat[:] = 0.0
        x = np.take(net.embed, context, axis=0, out=self._array("x", n, 2 * REACH, EMBEDDING), mode="clip").reshape(n, -1)
        h = _hidden(net, x, self._array("h", n, HIDDEN + 1))

        def slopes(logits: np.ndarray, own: np.ndarray) -> tuple[float, np.ndarray]:
            logs, d, sums = _softmax(logits, own)
            d *= (-share / sums)[:, None]
            d.reshape(-1)[at + own] += share
            return float(logs @ times.astype(np.float64)), d

        total, d = slopes(np.dot(h, net.to_klass, out=self._array("logits", n, CLASSES)), ids // WITHIN)
        np.dot(h.T, d, out=grad.to_klass)
        dh = np.dot(d, net.klass.T, out=self._array("dh", n, HIDDEN))
        more, d = slopes(_tokens(net, h, parts, self._array("logits", n, WITHIN)), ids % WITHIN)
        total += more
        dh_token = self._array("dh_token", n, HIDDEN)
        for c, own in parts:
            np.dot(h[own].T, d[own], out=grad.to_token[c])
            np.dot(d[own], net.within[c].T, out=dh_token[own])
        dh += dh_token
        h = h[:, :HIDDEN]
        dh *= np.subtract(1.0, np.multiply(h, h, out=dh_token), out=dh_token)
        np.dot(x.T, dh, out=grad.into)
        np.sum(dh, axis=0, out=grad.bias)
        dx = np.matmul(net.into, dh.T, out=self._array("dx", 2 * REACH * EMBEDDING, n)).reshape(2 * REACH, EMBEDDING, n)
        flat = context.T.ravel()
        embed = self._array("embed", EMBEDDING, VOCABULARY + 1)
        embed[...] = 0.0
        for j in range(EMBEDDING):
            np.add.at(embed[j], flat, dx[:, j].ravel())
        grad.embed[...] = embed.T
        g, work = grad.flat, self.work
        np.multiply(g, g, out=work)
        self.square += work
        np.sqrt(self.square, out=work)
        g *= self.rate
        g /= work
        net.flat += g
        return float(total / times.sum(dtype=np.float64))


# --- over the corpus


def runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All documents, some in a row: a hash of key and text each, and their tokens as places in the row's distinct words."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(key, text).alias("h"), text_bytes(text).alias("t"))

    def cut(batches: Iterator[Batch]) -> Iterator[Batch]:
        for b in batches:
            start, found, held = 0, [], 0
            for i, raw in enumerate(b["t"]):
                found.append(pa.array(tokens(raw), pa.string()))
                held += len(found[-1])
                if held >= RUN or i + 1 == len(b["t"]):
                    coded = pa.chunked_array(found).combine_chunks().dictionary_encode()
                    at, words = coded.indices.to_numpy(), coded.dictionary
                    yield {
                        "words": pa.ListArray.from_arrays([0, len(words)], words),
                        "n": [np.bincount(at, minlength=len(words))],
                        "doc_id": [b["k"][start : i + 1]],
                        "h": [b["h"][start : i + 1]],
                        "n_tokens": [[len(x) for x in found]],
                        "places": [at.astype(_width(len(words))).tobytes()],
                    }
                    start, found, held = i + 1, [], 0

    return map_batches(rows, cut, _RUNS)


_RUNS = "words array<string>, n array<long>, doc_id array<long>, h array<long>, n_tokens array<long>, places binary"


def _width(words: int) -> type:
    """The places' type: 2 bytes, or 4 where there are too many words."""
    return np.uint16 if words <= 1 << 16 else np.uint32


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id") -> list[str]:
    """The most frequent words of all documents, most frequent first."""
    return frequent(runs(docs, text, key))


def frequent(cut: DataFrame) -> list[str]:
    """The same from runs."""
    counted = cut.select(F.explode(F.arrays_zip("words", "n")).alias("of")).select("of.words", "of.n")
    whole = counted.groupBy(F.col("words").alias("word")).agg(F.sum("n").alias("n"))
    return [r.word for r in whole.orderBy(F.desc("n"), "word").limit(VOCABULARY - RARE).collect()]


def numbering(words: list[str]) -> ByMiss:
    """word -> number; words without one of their own share RARE buckets by hash."""
    own = {w: i for i, w in enumerate(words)}
    return ByMiss(lambda w: own[w] if w in own else VOCABULARY - RARE + zlib.crc32(w.encode("utf-8", "replace")) % RARE)


def _ids(raw: bytes, number: ByMiss) -> np.ndarray:
    found = tokens(raw)
    return np.fromiter(map(number.__getitem__, found), np.uint16, len(found))


def encode(docs: DataFrame, words: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, h, ids) of every row: a hash of key and text, and the numbers of the text's tokens, 16 bits each."""
    return encode_runs(runs(docs, text, key), words)


def encode_runs(cut: DataFrame, words: list[str]) -> DataFrame:
    """The same from runs."""
    sent = cut.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.array(sent.value, pa.string())
        for b in batches:
            for words_of, ids, h, lengths, places in zip(*(b[c] for c in _CODED), strict=True):
                numbers = _numbers(words_of.values, own)
                whole = numbers[np.frombuffer(places.as_py(), _width(len(numbers)))]
                coded = [x.tobytes() for x in np.split(whole, np.cumsum(lengths.values.to_numpy()[:-1]))]
                yield pa.RecordBatch.from_arrays([ids.values, h.values, pa.array(coded, pa.binary())], ["doc_id", "h", "ids"])

    return cut.select(*_CODED).mapInArrow(run, "doc_id long, h long, ids binary")


_CODED = ["words", "doc_id", "h", "n_tokens", "places"]


def _numbers(words: pa.Array, own: pa.Array) -> np.ndarray:
    """The number of each word, as by `numbering`."""
    found = pc.fill_null(pc.index_in(words, value_set=own), -1).to_numpy(zero_copy_only=False)
    rare = found < 0
    crc = map(zlib.crc32, words.filter(pa.array(rare)).cast(pa.binary()).to_pylist())
    numbers = found.astype(np.uint16)
    numbers[rare] = VOCABULARY - RARE + np.fromiter(crc, np.int64, int(rare.sum())) % RARE
    return numbers


def deal(coded: DataFrame, docs_per_trainer: int = DOCS_PER_TRAINER, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """(round, trainer, h, ids) of every encoded document with a token, and the number of trainers of a round."""
    trainers = max(1, -(-coded.count() // (docs_per_trainer * rounds)))
    mixed = F.col("h").bitwiseAND(2**63 - 1)
    at = (mixed % rounds).cast("int").alias("round"), (F.shiftright(mixed, 20) % trainers).cast("int").alias("trainer")
    return coded.where(F.length("ids") > 0).select(*at, "h", "ids"), trainers


def train(docs: DataFrame, words: list[str], text: str = "text", key: str = "doc_id", **training) -> Network:
    """The averaged network of all trainers; every token of every document trains, in one of the rounds."""
    return train_coded(store(encode(docs, words, text, key), "coded"), **training)


def train_coded(coded: DataFrame, docs_per_trainer: int = DOCS_PER_TRAINER, rounds: int = ROUNDS, rate: float = 0.1) -> Network:
    """The same from encoded documents, which are read once a round."""
    spark = coded.sparkSession
    dealt, trainers = deal(coded, docs_per_trainer, rounds)
    net = Network.fresh()
    for i in range(rounds):
        sent = spark.sparkContext.broadcast(net.flat)

        def teach(rows: pd.DataFrame) -> pd.DataFrame:
            flat = sent.value
            own = Network(flat.copy())
            each = rows.groupby(["h", "ids"], sort=True).size().reset_index(name="times")  # rows that repeat key and text
            seen = _pass(Trainer(own, rate), each["ids"], each["times"])
            node, slices = int(rows["trainer"].iloc[0]), range(0, len(flat), _SLICE)
            return pd.DataFrame({"node": node, "slice": [s // _SLICE for s in slices], "weight": float(seen), "sums": [(own.flat[s : s + _SLICE].astype(np.float64) * seen).tobytes() for s in slices]})

        taught = dealt.where(F.col("round") == i).drop("round").groupBy("trainer").applyInPandas(teach, _SLICES)
        net = Network(_average(store(taught, "taught"), trainers, net.flat))
    return net


_SLICES = "node int, slice int, weight double, sums binary"


def _pass(trainer: Trainer, ids: Iterable[bytes], times: Iterable[int]) -> int:
    """Steps over every token of the encoded texts in random order; gives how many tokens they stand for."""
    rows = [np.frombuffer(i, np.uint16) for i in ids]
    wide, places = _wide(rows)
    times = np.fromiter(times, np.int32)
    weight = np.repeat(times, [len(r) for r in rows])
    repeated = (times != 1).any()
    order = np.random.default_rng(len(places)).permutation(len(places))
    batch = min(BATCH, max(64, len(places) // STEPS))
    for s in range(0, len(order), batch):
        at = order[s : s + batch]
        p = places[at]
        trainer.step(_windows(wide, p), wide[p].astype(np.int64), weight[at] if repeated else weight[: len(at)])  # all are one
    return int(weight.sum(dtype=np.int64))


def _wide(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, apart so that they don't see each other, and the places of their tokens."""
    gap = np.full(REACH, VOCABULARY, np.uint16)
    wide = np.concatenate([gap, *(x for r in rows for x in (r, gap))])
    return wide, np.flatnonzero(wide != VOCABULARY)


def _windows(wide: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.stack([wide[places + i] for i in range(-REACH, REACH + 1) if i], axis=1).astype(np.int64)


def _average(taught: DataFrame, nodes: int, before: np.ndarray) -> np.ndarray:
    """Weighted mean of the trainers' parameters, summed by slice in a tree of fan-in _FAN."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")  # sums in one order, whatever the tasks
        sums = np.sum([np.frombuffer(s) for s in rows["sums"]], axis=0)
        return pd.DataFrame({"node": [rows["node"].iloc[0] // _FAN], "slice": [rows["slice"].iloc[0]], "weight": [rows["weight"].sum()], "sums": [sums.tobytes()]})

    while True:
        taught = taught.groupBy((F.col("node") / F.lit(_FAN)).cast("int").alias("parent"), F.col("slice").alias("of")).applyInPandas(add, _SLICES)
        nodes = -(-nodes // _FAN)
        if nodes <= 1:
            break
        taught = store(taught, "averages")
    rows = sorted(taught.collect(), key=lambda r: r.slice)  # one row a slice
    if not rows:
        return before
    return np.concatenate([np.frombuffer(r.sums) / r.weight for r in rows]).astype(np.float32)


def score(docs: DataFrame, words: list[str], net: Network, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_tokens, log_likelihood and perplexity."""
    return score_coded(encode(docs, words, text, key), net)


def score_coded(coded: DataFrame, net: Network) -> DataFrame:
    """The same of encoded documents."""
    sent = coded.sparkSession.sparkContext.broadcast(net.flat)

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        own = Network(sent.value)
        for b in batches:
            rows = [np.frombuffer(raw, np.uint16) for raw in b["ids"]]
            lengths = np.asarray([len(x) for x in rows])
            wide, places = _wide(rows)
            of, total = np.repeat(np.arange(len(rows), dtype=np.uint16), lengths), np.zeros(len(rows))
            for at in range(0, len(places), BLOCK):  # short texts share a block; a long one takes several
                p = places[at : at + BLOCK]
                found = log_probabilities(own, _windows(wide, p), wide[p].astype(np.int64))
                total += np.bincount(of[at : at + BLOCK], weights=found, minlength=len(total))
            yield {"doc_id": b["doc_id"], "n_tokens": lengths, "log_likelihood": total, "perplexity": np.exp(-total / np.maximum(lengths, 1))}

    return map_batches(coded.select("doc_id", "ids"), run, SCHEMA)


def pseudo_likelihood(docs: DataFrame, text: str = "text", key: str = "doc_id", **training) -> DataFrame:
    """Count, encode, train and score."""
    cut = store(runs(docs, text, key), "runs")
    coded = store(encode_runs(cut, frequent(cut)), "coded")
    return score_coded(coded, train_coded(coded, **training))
