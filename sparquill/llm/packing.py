"""Bounded-space online best-fit packing of token pieces into sequences.

pack_documents(docs) tokenizes every whole text, appends the end id, cuts only
texts longer than `capacity` tokens and packs the pieces.

Packing is online best-fit with a fixed number of open bins. The bins stand in a
bitset keyed by free space, so the tightest bin that takes a piece is the lowest
set bit at or above its length. When no bin takes it and all are open, the fullest
closes first. Each task packs its own pieces as it tokenizes them, so nothing but
the thin result is ever moved. The bins still open when a task ends are packed
once more as items, largest first, in groups of `merge_bins`: a sequence is then a
chain of such bins. What stays unfilled is the open bins of the last round and the
gaps that no piece fitted.

Tokens equal the library's: the vocabulary drops white space between words, so a
text's ids are the concatenation of its words' ids and each worker keeps a bounded
table of words it has met.

Defined results: null and empty texts are one piece holding the end id alone;
repeated rows and null ids are packed as rows of their own; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import Batch, map_batches, store, text_bytes
from sparquill.llm.token_cache import load_tokenizer

CAPACITY = 4096
OPEN_BINS = 256
MERGE_BINS = 8192

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: kind 0: a piece; kind 1: a bin that was open at the end, `length` being its fill.
_ROWS = "kind int, " + SCHEMA


class BestFit:
    """At most `most` open bins of `capacity`; place(n) gives (bin, offset)."""

    def __init__(self, capacity: int, most: int, first: int = 0):
        if capacity < 1 or most < 1:
            raise ValueError("capacity and the number of open bins must be positive")
        self.capacity, self.most, self.next = capacity, most, first
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.open = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
            del self.by_free[free]
        self.open -= 1
        return found

    def place(self, n: int) -> tuple[int, int]:
        if not 0 < n <= self.capacity:
            raise ValueError(f"a piece of {n} doesn't fit a bin of {self.capacity}")
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, found = self.capacity, self.next
            self.next += 1
        if left := free - n:
            self.by_free.setdefault(left, []).append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free

    def remaining(self) -> Iterator[tuple[int, int]]:
        """(bin, fill) of the open bins."""
        for free, bins in sorted(self.by_free.items()):
            for b in bins:
                yield b, self.capacity - free


#: Latin letters, then at most one run of punctuation: one or two pre-tokens, whatever surrounds them.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([.,;:!?]*)")


_STOP = re.compile(rb"[.,](?<=[a-z][.,])(?=[ \n])")


def _plainer(raw: bytes) -> bytes:
    """The text with the same ids and fewer different words.

    ASCII letters are lower-cased, as the vocabulary does anyway, and a full stop or
    comma between a letter and white space, a pre-token of its own, is set apart.
    Texts that may hold special strings stay as they are.
    """
    return raw if b"<|" in raw else _STOP.sub(rb" \g<0>", raw.lower())


class WordIds:
    """bytes of a text -> its ids as little-endian unsigned 32-bit bytes.

    A bounded table of words is shared by the texts of a worker. Plain words it lacks
    are encoded many at a time and told apart by the ids that end a pre-token, others
    one at a time.
    """

    def __init__(self, tokenizer_file: str, most: int = 1_000_000, suffix: str = "</w>"):
        self.tokenizer, self.most = load_tokenizer(tokenizer_file), most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}

    def __call__(self, raws: Iterable[bytes], at_once: int = 100_000) -> Iterator[bytes]:
        """Ids of each text; words are learnt for many texts together, a long text's in parts."""
        held: list[list[bytes]] = []
        n = 0
        for raw in raws:
            words = _plainer(raw).split()
            if len(words) > at_once:
                yield from self._texts(held)
                held, n = [], 0
                yield b"".join(next(self._texts([words[s : s + at_once]])) for s in range(0, len(words), at_once))
                continue
            held.append(words)
            n += len(words)
            if n >= at_once:
                yield from self._texts(held)
                held, n = [], 0
        yield from self._texts(held)

    def _texts(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        known = self.known
        wanted = set().union(*texts)
        missing = {w for w in wanted if w not in known}
        if len(known) + len(missing) > self.most:
            known.clear()
            missing = wanted
        if missing:
            self._learn(missing)
        for words in texts:
            yield b"".join(map(known.__getitem__, words))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        plain, texts, parts, odd = [], [], [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            if m := _PLAIN.fullmatch(text):
                plain.append(w)
                texts.append(text)
                parts.append(2 if m[1] else 1)
            else:
                odd.append((w, text))
        for (w, _), ids in zip(odd, self._encode([text for _, text in odd]), strict=True):
            self.known[w] = ids.tobytes()
        groups = range(0, len(plain), 1024)
        for s, ids in zip(groups, self._encode([" ".join(texts[s : s + 1024]) for s in groups]), strict=True):
            last = np.flatnonzero(self.ends[ids])[np.cumsum(parts[s : s + 1024]) - 1] + 1
            data, at = ids.tobytes(), 0
            for w, end in zip(plain[s : s + 1024], (4 * last).tolist(), strict=True):
                self.known[w] = data[at:end]
                at = end
            if at != len(data):
                raise RuntimeError("words and ids don't match")


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def _first_bin() -> int:
    task = TaskContext.get()
    return (task.partitionId() if task else 0) << 40


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 1, open_bins: int = OPEN_BINS, merge_bins: int = MERGE_BINS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    end = np.asarray([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[Batch]) -> Iterator[Batch]:
        ids_of, packer = word_ids(tokenizer_file), BestFit(capacity, open_bins, _first_bin())
        names = [c.split()[0] for c in _ROWS.split(", ")]
        for b in batches:
            rows = []
            for doc, ids in zip(b["k"], ids_of(b["t"]), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((0, doc, piece, at // 4, len(part) // 4, zlib.crc32(part), *packer.place(len(part) // 4)))
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
        rest = list(packer.remaining())
        none = [None] * len(rest)
        yield {"kind": [1] * len(rest), "doc_id": none, "piece": none, "start": none, "length": [fill for _, fill in rest], "ids_crc32": none, "sequence_id": [b for b, _ in rest], "offset": none}

    rows = docs.select(F.col(key).cast("long").alias("k"), text_bytes(text).alias("t"))
    packed = store(map_batches(rows, pieces, _ROWS), "packed")
    moves = merge_open(packed.where("kind = 1").select("sequence_id", "length"), capacity, open_bins, merge_bins)
    placed = packed.where("kind = 0").join(moves, "sequence_id", "left")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("into", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def merge_open(bins: DataFrame, capacity: int, open_bins: int, merge_bins: int) -> DataFrame:
    """(sequence_id, length) of part-filled bins to (sequence_id, into, base): which bin each joins, and where."""

    def merge(batches: Iterator[Batch]) -> Iterator[Batch]:
        packer, at = BestFit(capacity, open_bins), {}
        for b in batches:
            into, base = [], []
            for name, n in zip(b["sequence_id"], b["length"], strict=True):
                found, offset = packer.place(n)
                into.append(at.setdefault(found, name))  # a chain goes by the name of its first bin
                base.append(offset)
            yield {"sequence_id": b["sequence_id"], "into": into, "base": base}

    groups = max(1, -(-bins.count() // merge_bins))
    dealt = bins.repartition(groups, F.xxhash64("sequence_id")).sortWithinPartitions(F.desc("length"), "sequence_id")
    return map_batches(dealt, merge, "sequence_id long, into long, base long")
