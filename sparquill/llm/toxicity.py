"""Toxicity: a linear-chain conditional random field over tokens.

Labels are given by document, so tokens are labelled first (`label_tokens`): words
and word beginnings that occur in toxic training documents far beyond chance and
hardly in clean ones mark their tokens there. Near copies are counted once, by
sketches of their word triples, so that what a copied document happens to contain
isn't taken for an offence. The chain (`fit_chain`) then learns, by likelihood with
forward-backward gradients, what marks a token (the word, its beginnings and ending,
its neighbours) and how marks follow each other. A Tagger gives each token its
marginal probability; a document's score is a logistic function, fitted on the
training documents, of the largest marginal and the sum of all but slight ones, and its
offending spans are the runs of tokens above one half.

Training reads a bounded sample: at most `toxic_docs` and `clean_docs` labelled
documents of at most `longest` bytes, by hash order of their ids, each of them whole;
where ids repeat, the bound holds for the different texts of all of them together.
Scoring reads every text whole. A text is one chain, whatever its length: it is laid
out in rows of `WINDOW` tokens for numpy, and forward and backward messages go from row
to row. Words are runs of letters, digits and underscores.

Defined results: null and empty texts get the score of a document without marks;
without labelled rows every score is 0, with rows of one label only every score is
that label; a document labelled more than once counts as toxic if any label is;
repeated rows and null ids give a row each; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from math import lgamma, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import Batch, ByMiss, filter_batches, map_batches, text_bytes

WORD = re.compile(r"\w+")
DIM = 1 << 18
WINDOW = 64
#: Bounds of the training sample.
TOXIC_DOCS, CLEAN_DOCS, LONGEST = 1500, 2500, 50_000
BEGINNINGS = (3, 4, 5, 6, 7, 8)


def parts(word: str) -> list[str]:
    """The word and its beginnings, as names of features."""
    return ["=" + word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


def slots(words: list[str]) -> np.ndarray:
    """Feature numbers of words, a row each: itself, its beginnings, its ending, as predecessor, as successor; DIM for none.

    A piece of a word is hashed as a polynomial of its characters, mod 2**64, which sums
    along the word give for all words at once.
    """
    low = [w.lower() for w in words]
    n = np.fromiter(map(len, low), np.int64, len(low))
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(n) - n
    power = np.cumprod(np.full(max(int(n.max(initial=0)), 3), 0x9E3779B97F4A7C15, np.uint64))
    upto = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * power[np.arange(len(code)) - np.repeat(start, n)], out=upto[1:])
    piece = lambda k: upto[start + np.minimum(k, n)] - upto[start]
    end = np.zeros(len(low), np.uint64)
    for k in range(3):  # from the last character on
        has = n > k
        end[has] += code[(start + n - 1 - k)[has]] * power[k]
    whole = piece(n)

    def number(kind: int, x: np.ndarray) -> np.ndarray:
        x = (x ^ np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(DIM)).astype(np.int32)

    begins = [np.where(n >= k, number(1, piece(k)), DIM) for k in BEGINNINGS]
    return np.stack([number(2, whole), *begins, number(3, end), number(4, whole), number(5, whole)], axis=1).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIM, np.float32))
    #: log potentials of (from, to), 0 clean and 1 marked
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = -4.0
    #: of the score: weights of (largest marginal's logit, log of the sum of those from 0.02) and a constant
    score: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float | None = 0.0

    def potentials(self, words: list[str]) -> np.ndarray:
        """Log potentials that each word gives its own place, the next one and the one before."""
        w = np.append(self.weights, np.float32(0))[slots(words)].astype(np.float64)
        return np.stack([w[:, :-2].sum(axis=1), w[:, -2], w[:, -1]], axis=1)


# --- token labels


def sketches(words: list[str]) -> tuple[int, int]:
    """Least and greatest hash of the word triples: near copies mostly share both."""
    found = [zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))]
    return min(found), max(found)


def label_tokens(docs: list[list[str]], toxic: np.ndarray, least: int = 5, precision: float = 0.9, chance: float = 1e-3) -> set[str]:
    """Features of offence: in at least `least` toxic groups of near copies, seldom in clean ones, and not by chance.

    By chance: the odds that so many groups with the feature are toxic, if toxicity
    fell on groups at random, times the number of features, must be below `chance`.
    """
    seen = [sketches(words) for words in docs]
    base = max(len({s for s, y in zip(seen, toxic, strict=True) if y}), 1) / max(len(set(seen)), 1)
    chosen: set[str] = set()
    distinct = [set(words) for words in docs]
    for cut in (None, *BEGINNINGS):  # one length at a time keeps the tables small
        of_doc = lambda words, n=cut: words if n is None else {w[:n] for w in words if len(w) >= n}
        hits = Counter(f for words, y in zip(distinct, toxic, strict=True) if y for f in of_doc(words))
        groups: dict[str, list[set[int]]] = {f: [set(), set(), set()] for f, n in hits.items() if n >= least}
        features = len(hits)
        del hits
        for words, y, (low, high) in zip(distinct, toxic, seen, strict=True):
            for f in groups.keys() & of_doc(words):
                found = groups[f]
                if y:
                    found[0].add(low)
                    found[1].add(high)
                else:
                    found[2].add(low)
        for f, (low, high, clean) in groups.items():
            a, b = min(len(low), len(high)), len(clean)
            if a < least or a < precision * (a + b):
                continue
            # the binomial tail's largest term bounds it closely enough here
            log_chance = lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + a * log(base) + b * log(max(1 - base, 1e-9))
            if log_chance + log(features) < log(chance):
                chosen.add("=" + f if cut is None else "^" + f)
    return chosen


# --- the chain


def windows(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers as a matrix of windows, and which of its places are filled."""
    starts = np.cumsum([0, *lengths])
    begin = np.concatenate([np.arange(s, e, WINDOW) for s, e in zip(starts[:-1], starts[1:], strict=True)] or [np.empty(0, np.int64)]).astype(np.int64)
    end = np.concatenate([np.minimum(np.arange(s, e, WINDOW) + WINDOW, e) for s, e in zip(starts[:-1], starts[1:], strict=True)] or [np.empty(0, np.int64)]).astype(np.int64)
    at = begin[:, None] + np.arange(WINDOW)
    filled = at < end[:, None]
    return np.where(filled, at, 0), filled


def _ahead(psi: np.ndarray, ok: np.ndarray, transition: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward shares by place and row, and the rows' log normalisers; enter: the share before a row, nan where a chain begins."""
    (c00, c01), (c10, c11) = np.exp(transition)
    forward, logz = np.empty(psi.shape), np.zeros(psi.shape[1])
    begins = np.isnan(enter)
    p = np.where(begins, 0.0, enter)
    for t in range(len(psi)):
        f0, f1 = c00 + p * (c10 - c00), (c01 + p * (c11 - c01)) * psi[t]
        if t == 0:
            f0, f1 = np.where(begins, 1.0, f0), np.where(begins, psi[0], f1)
        s = f0 + f1
        p = forward[t] = f1 / s
        logz += np.where(ok[t], np.log(s), 0.0)
    return forward, logz


def _messages(psi: np.ndarray, ok: np.ndarray, transition: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(forward share before each row, backward share at each row's last place), along the chains of rows."""
    n = psi.shape[1]
    enter, leave = np.full(n, np.nan), np.full(n, 0.5)
    later = np.flatnonzero(follows)
    if not len(later):
        return enter, leave
    (c00, c01), (c10, c11) = np.exp(transition)
    # what a row that follows makes of the states before it: (from, to), normalised as a whole
    m = np.zeros((2, 2, len(later)))
    m[0, 0] = m[1, 1] = 1.0
    for x, filled in zip(psi[:, later], ok[:, later], strict=True):
        to = np.stack([m[:, 0] * c00 + m[:, 1] * c10, (m[:, 0] * c01 + m[:, 1] * c11) * x], axis=1)
        m = np.where(filled, to / to.sum(axis=(0, 1)), m)
    step = np.empty((2, 2, n))
    step[:, :, later] = m
    first = np.flatnonzero(~follows)
    nth = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))  # of its chain
    opens = np.flatnonzero((nth == 0) & np.r_[follows[1:], False])
    end = np.full(n, np.nan)  # forward share at a row's last place
    end[opens] = _ahead(psi[:, opens], ok[:, opens], transition, np.full(len(opens), np.nan))[0][-1]
    order = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[order], np.arange(1, int(nth.max()) + 2))
    levels = [order[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]  # second rows, third rows, ...
    for rows in levels:
        p = enter[rows] = end[rows - 1]
        to0, to1 = (1.0 - p) * step[0, 0, rows] + p * step[1, 0, rows], (1.0 - p) * step[0, 1, rows] + p * step[1, 1, rows]
        end[rows] = to1 / (to0 + to1)
    for rows in reversed(levels):
        q = leave[rows]
        from0, from1 = step[0, 0, rows] * (1.0 - q) + step[0, 1, rows] * q, step[1, 0, rows] * (1.0 - q) + step[1, 1, rows] * q
        leave[rows - 1] = from1 / (from0 + from1)
    return enter, leave


def forward_backward(emission: np.ndarray, filled: np.ndarray, transition: np.ndarray, follows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of marks, forward and backward shares of the marked state, and the log normaliser, per row.

    emission: log potential of a mark against none, (rows, WINDOW). follows: which rows go on
    the chain of the row before (none); all but a chain's last row must be full. With two
    states a normalised message is one number, the marked state's share.
    """
    (c00, c01), (c10, c11) = np.exp(transition)
    psi = np.exp(np.clip(emission, -40, 40)).T.copy()  # by place, so that each step reads one row
    ok = np.ascontiguousarray(filled.T)
    width, n = psi.shape
    enter, leave = _messages(psi, ok, transition, np.zeros(n, bool) if follows is None else follows)
    forward, logz = _ahead(psi, ok, transition, enter)
    backward = np.full((width, n), 0.5)
    backward[-1] = leave
    for t in range(width - 2, -1, -1):
        q = backward[t + 1]
        b1, b0 = q * psi[t + 1], 1.0 - q
        m1, m0 = c10 * b0 + c11 * b1, c00 * b0 + c01 * b1
        backward[t] = np.where(ok[t + 1], m1 / (m0 + m1), 0.5)
    both = forward * backward
    marginal = both / (both + (1.0 - forward) * (1.0 - backward))
    return marginal.T, forward.T, backward.T, logz


def _pairs(forward: np.ndarray, backward: np.ndarray, emission: np.ndarray, filled: np.ndarray, transition: np.ndarray, follows: np.ndarray | None = None) -> np.ndarray:
    """Expected counts of (from, to) over all rows, and from a row to the one that follows it."""
    before = np.stack([1.0 - forward, forward], axis=2)
    psi = np.exp(np.clip(emission, -40, 40))
    after = np.stack([1.0 - backward, backward * psi], axis=2)

    def expected(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        m = x[:, :, None] * np.exp(transition)[None] * y[:, None, :]
        return (m / m.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

    inner = filled[:, 1:]
    found = expected(before[:, :-1][inner], after[:, 1:][inner])
    if follows is not None and follows.any():
        rows = np.flatnonzero(follows)
        found += expected(before[rows - 1, -1], after[rows, 0])
    return found


def fit_chain(docs: list[list[str]], marks: list[np.ndarray], model: Model, epochs: int = 6, rate: float = 0.3, decay: float = 1e-4, batch: int = 256, seed: int = 7) -> None:
    """Fit weights, bias and transitions by AdaGrad on the chains' likelihood."""
    number: dict[str, int] = {}
    lengths = [len(words) for words in docs]
    if not sum(lengths):
        return
    ids = np.fromiter((number.setdefault(w, len(number)) for words in docs for w in words), np.int32, sum(lengths))
    gold = np.concatenate(marks)
    first = np.zeros(len(ids) + 1, bool)  # a document's first token, and the end
    first[np.cumsum([0, *lengths])] = True
    every = slots(list(number))
    own, side = every[:, :-2], every[:, -2:]
    del number

    def features(at: np.ndarray) -> np.ndarray:
        before = np.where(first[at], DIM, side[ids[at - 1], 0])
        after = np.where(first[at + 1], DIM, side[ids[np.minimum(at + 1, len(ids) - 1)], 1])
        return np.concatenate([own[ids[at]], before[..., None], after[..., None]], axis=-1)

    at, filled = windows(lengths)
    n_rows = -(-np.asarray(lengths) // WINDOW)
    ends = np.cumsum(n_rows)
    goes_on = np.ones(len(at), bool)
    goes_on[(ends - n_rows)[n_rows > 0]] = False
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(DIM + 1), np.full(DIM + 1, 1e-2)
    extra, e2 = np.concatenate([[model.bias], np.zeros(4)]), np.full(5, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(n_rows))
        part = np.cumsum(n_rows[order]) // batch  # whole documents of about `batch` rows a step
        for chosen in np.split(order, np.flatnonzero(np.diff(part)) + 1):
            rows = np.concatenate([np.arange(ends[i] - n_rows[i], ends[i]) for i in chosen])
            a, ok, follows = at[rows], filled[rows], goes_on[rows]
            f = features(a)
            w[DIM] = 0.0
            emission = w[f].sum(axis=2) + extra[0]
            transition = extra[1:].reshape(2, 2)
            p, alpha, beta, _ = forward_backward(emission, ok, transition, follows)
            y = gold[a].astype(float)
            error = (y - p) * ok / len(rows)
            grad = np.bincount(f.ravel(), weights=np.repeat(error.ravel(), f.shape[2]), minlength=DIM + 1) - decay * w
            moved = np.flatnonzero(grad)
            g2[moved] += grad[moved] ** 2
            w[moved] += rate * grad[moved] / np.sqrt(g2[moved])
            y2 = np.stack([1 - y, y], axis=2)
            real = np.einsum("ntf,nts->fs", y2[:, :-1] * ok[:, 1:, None], y2[:, 1:])
            on = np.flatnonzero(follows)
            real += y2[on - 1, -1].T @ y2[on, 0]
            more = np.concatenate([[error.sum()], ((real - _pairs(alpha, beta, emission, ok, transition, follows)) / len(rows)).ravel()]) - decay * extra
            e2 += more**2
            extra = extra + 0.1 * more / np.sqrt(e2)
    model.weights = w[:DIM].astype(np.float32)
    model.bias, model.transition = float(extra[0]), extra[1:].reshape(2, 2)


class Tagger:
    """Marginals of a batch of tokenised texts, with a bounded table of words' potentials."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.row: dict[str, int] = {}
        self.values = np.empty((1 << 16, 3), np.float32)

    def _rows(self, docs: list[list[str]], total: int) -> np.ndarray:
        row = self.row
        wanted = set().union(*docs)
        missing = {w for w in wanted if w not in row}
        if len(row) + len(missing) > self.most:
            row.clear()
            missing = wanted
        if len(row) + len(missing) > len(self.values):
            self.values = np.resize(self.values, (2 * (len(row) + len(missing)), 3))
        if missing:
            new = list(missing)
            self.values[len(row) : len(row) + len(new)] = self.model.potentials(new)
            row.update(zip(new, range(len(row), len(row) + len(new)), strict=True))
        return np.fromiter(map(row.__getitem__, chain.from_iterable(docs)), np.int64, total)

    def __call__(self, docs: list[list[str]]) -> list[np.ndarray]:
        lengths = [len(d) for d in docs]
        total = sum(lengths)
        if not total:
            return [np.empty(0) for _ in docs]
        rows = self._rows(docs, total)
        x = self.values[rows]
        emission = x[:, 0] + np.float64(self.model.bias)
        follows = np.ones(total, bool)
        ends = np.cumsum(lengths)
        follows[np.r_[0, ends[ends < total]]] = False  # a document's first token follows none
        at = np.flatnonzero(follows)
        emission[at] += x[at - 1, 1]
        emission[at - 1] += x[at, 2]
        places, filled = windows(lengths)
        p = np.empty(total)
        goes_on = follows[places[:, 0]]
        begins = np.flatnonzero(~goes_on)
        for cut in np.split(np.arange(len(places)), begins[1:][np.diff(begins[1:] // 8192, prepend=0) > 0]):  # whole texts
            own, ok = places[cut], filled[cut]
            p[own[ok]] = forward_backward(emission[own], ok, self.model.transition, goes_on[cut])[0][ok]
        return np.split(p, ends[:-1])


def summary(p: np.ndarray) -> np.ndarray:
    """What a document's score is made of. Marginals below 0.02 stay out of the sum, so that length alone
    adds up to nothing."""
    top = min(max(float(p.max()) if len(p) else 0.0, 1e-6), 1 - 1e-6)
    return np.asarray([np.log(top / (1 - top)), np.log(1e-2 + float(p[p >= 0.02].sum())), 1.0])


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method, the classes balanced as they are."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - decay * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w)), grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A Model from labelled texts."""
    y = np.asarray(toxic, int)
    model = Model()
    if not len(y) or y.min() == y.max():
        model.constant = float(y[0]) if len(y) else 0.0
        return model
    same: dict[str, str] = {}
    docs = [[same.setdefault(w, w) for w in WORD.findall(t.lower())] for t in texts]
    offence = label_tokens(docs, y)
    known = ByMiss(lambda w: any(f in offence for f in parts(w)))
    marks = [np.fromiter((known[w] for w in words), bool, len(words)) if y[i] else np.zeros(len(words), bool) for i, words in enumerate(docs)]
    fit_chain(docs, marks, model)
    tagger = Tagger(model)
    x = np.stack([summary(p) for s in range(0, len(docs), 256) for p in tagger(docs[s : s + 256])])
    model.score, model.constant = _logistic(x, y), None
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, longest: int = LONGEST) -> Model:
    """A Model from a bounded sample; which rows of labels may teach is the caller's choice."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    short = docs.select(F.col(key).alias("k"), text_bytes(text).alias("t")).where(F.octet_length("t") <= longest)
    pick = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(n)
    chosen = pick(1, toxic_docs).unionByName(pick(0, clean_docs))
    # an id may repeat, so rows are made distinct by id and digest, and bounded, before any text is collected
    met = short.join(F.broadcast(chosen), "k").groupBy("k", "y", F.xxhash64("t").alias("h")).agg(F.min("t").alias("t"))
    sample = met.orderBy(F.xxhash64("k"), "k", "h").limit(toxic_docs + clean_docs).select("k", "h", "y", "t")

    def learn(batches: Iterator[Batch]) -> Iterator[Batch]:
        rows = sorted((k, h, bytes(t), int(y)) for b in batches for k, h, y, t in zip(b["k"], b["h"], b["y"], b["t"], strict=True))
        texts: dict[str, int] = {}
        for _, _, raw, y in rows:
            t = raw.decode("utf-8", "replace")
            texts[t] = max(texts.get(t, 0), y)
        yield {"model": [pickle.dumps(fit(list(texts), list(texts.values())))]}

    # the sample is one partition of bounded size; an executor learns from it and the driver gets the model alone
    learnt = map_batches(sample.coalesce(1), learn, "model binary").first()
    return pickle.loads(learnt.model) if learnt else fit([], [])


def score_texts(raws: list[bytes], model: Model, tagger: Tagger) -> list[float]:
    if model.constant is not None:
        return [model.constant] * len(raws)
    found: list[float] = []
    batch: list[list[str]] = []
    held = 0
    for i, raw in enumerate(raws):
        words = WORD.findall(raw.decode("utf-8", "replace"))
        batch.append(words)
        held += len(words)
        if held >= 200_000 or i == len(raws) - 1:
            for p in tagger(batch):
                found.append(float(1 / (1 + np.exp(-np.clip(summary(p) @ model.score, -30, 30)))))
            batch, held = [], 0
    return found


def spans(text: str, model: Model, tagger: Tagger | None = None, least: float = 0.5) -> list[tuple[int, int, float]]:
    """(start, end, probability) of each run of tokens above `least`, in characters of the text."""
    if model.constant is not None:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    p = (tagger or Tagger(model))([[text[s:e] for s, e in at]])[0]
    found: list[tuple[int, int, float]] = []
    last = -2
    for i in np.flatnonzero(p >= least).tolist():
        if i == last + 1:
            s, _, q = found[-1]
            found[-1] = s, at[i][1], max(q, float(p[i]))
        else:
            found.append((*at[i], float(p[i])))
        last = i
    return found


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", offsets: bool = False) -> DataFrame:
    """Per document: doc_id, score, predicted and, if asked, spans of offending text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, predicted int" + (", spans array<struct<start: int, end: int, p: double>>" if offsets else "")

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        tagger = Tagger(shared.value)
        for b in batches:
            scores = score_texts(b["t"], shared.value, tagger)
            out: Batch = {"doc_id": b["k"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}
            if offsets:
                out["spans"] = [[{"start": s, "end": e, "p": p} for s, e, p in spans(raw.decode("utf-8", "replace"), shared.value, tagger)] if hit else [] for raw, hit in zip(b["t"], out["predicted"], strict=True)]
            yield out

    return map_batches(docs.select(F.col(key).cast("long").alias("k"), text_bytes(text).alias("t")), run, schema)


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, all columns, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        tagger = Tagger(shared.value)
        return lambda raws: [s < 0.5 for s in score_texts([r or b"" for r in raws], shared.value, tagger)]

    return filter_batches(docs, text, start)
