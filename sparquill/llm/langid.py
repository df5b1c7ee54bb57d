"""Language identification: multinomial naive Bayes over hashed character n-grams.

train(labelled) counts the n-grams of a bounded sample of labelled rows, at most
`docs_per_label` expected for each language (each has its own rate, so that a rare
language keeps all its rows), sums them by (language, bucket) and gives a Model
whose matrix of log probabilities has a row per language and `BUCKETS` columns.
predict(docs, model) broadcasts that matrix and scores batches of texts: an n-gram
is a column number, a text's log likelihoods are the sum of its columns.

Texts are lower-cased; n-grams are hashed from code points with a fixed mixer, so
the same text gives the same score anywhere. Long texts are scored in blocks of
`BLOCK` characters that overlap by the longest n-gram.

Defined results: a text that is null or has no letter is `und` with score 0, and so
is every text if there is nothing to learn from; equal likelihoods go to the
language that sorts first; rows without label or text teach nothing; repeated rows
and null ids give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import Batch, filter_batches, map_batches

BUCKETS = 1 << 16
LONGEST = 4
BLOCK = 1 << 18
#: The bound of the training sample: expected rows of each language.
DOCS_PER_LABEL = 2500
UNDETERMINED = "und"

_MIX = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    logs: np.ndarray  # (labels, BUCKETS), float32: a row per language lies together
    prior: np.ndarray  # (labels,)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the text's n-grams of 1 to LONGEST characters, block by block."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, max(len(codes), 1), BLOCK):
        part = codes[at : at + BLOCK + LONGEST - 1]
        whole = at + BLOCK >= len(codes)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, LONGEST + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] + part[n - 1 :] + np.uint32(n)) * _MIX
            h ^= h >> np.uint32(15)
            # each n-gram counts in the block where it starts
            own = h if whole else h[:BLOCK]
            yield (own * _MIX) >> np.uint32(16)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", docs_per_label: int = DOCS_PER_LABEL, smoothing: float = 0.5) -> Model:
    """A Model from the rows given; which rows may teach is the caller's choice."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("l")).where("l is not null and t is not null")
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    labels = tuple(sorted(sizes))
    if not labels:
        return Model((), np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    one = 1 << 30
    rate = F.create_map(*[x for name in labels for x in (F.lit(name), F.lit(min(one, one * docs_per_label // sizes[name])))])
    sample = rows.where(F.pmod(F.xxhash64("k"), F.lit(one)) < rate[F.col("l")])

    def count(batches: Iterator[Batch]) -> Iterator[Batch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for name, raw in zip(b["l"], b["t"], strict=True):
                counts = found.setdefault(name, np.zeros(BUCKETS, np.int64))
                for part in ngrams(raw.decode("utf-8", "replace")):
                    counts += np.bincount(part, minlength=BUCKETS)
        for name, counts in found.items():
            at = np.flatnonzero(counts)
            yield {"l": [name] * len(at), "bucket": at, "n": counts[at]}

    counted = map_batches(sample.select("l", F.col("t").cast("binary").alias("t")), count, "l string, bucket int, n long", rows=64)
    table = counted.groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows a language
    counts = np.zeros((BUCKETS, len(labels)))
    column = {name: i for i, name in enumerate(labels)}
    counts[table.column("bucket").to_numpy(), [column[x] for x in table.column("l").to_pylist()]] = table.column("n").to_numpy()
    logs = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * BUCKETS)
    share = np.asarray([sizes[x] for x in labels], float)
    return Model(labels, np.ascontiguousarray(logs.T, np.float32), np.log(share / share.sum()))


def score(texts: list[bytes | None], model: Model) -> tuple[list[str], list[float]]:
    """Predicted language and its posterior probability, per text."""
    names, scores = [], []
    for raw in texts:
        text = None if raw is None else raw.decode("utf-8", "replace")
        if not model.labels or text is None or not has_letter(text):
            names.append(UNDETERMINED)
            scores.append(0.0)
            continue
        total = model.prior.copy()
        for part in ngrams(text):
            total += np.take(model.logs, part, axis=1).sum(axis=1, dtype=np.float64)
        best = int(np.argmax(total))
        names.append(model.labels[best])
        scores.append(float(1.0 / np.exp(total - total[best]).sum()))
    return names, scores


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        for b in batches:
            names, scores = score(b["t"], shared.value)
            yield {"doc_id": b["k"], "lang_pred": names, "score": scores}

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").cast("binary").alias("t"))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double")


def keep_determined(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, all columns, whose text has a language: what `predict` calls `und` goes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_batches(docs, text, lambda: lambda raws: [x != UNDETERMINED for x in score(raws, shared.value)[0]])
