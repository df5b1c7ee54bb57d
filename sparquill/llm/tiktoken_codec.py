"""Byte-level BPE with the tiktoken library and a local rank file.

encode_decode(docs) encodes every whole text and decodes its ids again.

A text is cut before white space that follows something else: no match of the
pattern spans such a place and no look-ahead depends on what lies behind it, so
the pieces' ids concatenate to the text's ids. Texts of up to `piece_chars` stay
whole; longer ones are encoded piece by piece, so that memory follows the piece
and not the text. Ids decode to raw bytes, never by way of lossy strings.

Defined results: null text is empty text (0 tokens, digests of the empty string);
repeated rows and null ids give a row each; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import Batch, map_batches, text_bytes

PIECE_CHARS = 1 << 16
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n\t])")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut text at safe boundaries into pieces of at least `size` characters (the last may be shorter)."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str, enc, size: int = PIECE_CHARS) -> Iterator[list[int]]:
    for piece in pieces(text, size):
        yield enc.encode_ordinary(piece)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Per document: n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 (decoded bytes)."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            out: Batch = {"doc_id": b["k"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for raw in b["t"]:
                n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encode(raw.decode("utf-8", "replace"), enc, piece_chars):
                    if ids:
                        of_ids.update(((b"," if n else b"") + ",".join(map(str, ids)).encode()))
                        of_bytes.update(enc.decode_bytes(ids))
                        n += len(ids)
                out["n_tokens"].append(n)
                out["ids_sha256"].append(of_ids.hexdigest())
                out["decoded_sha256"].append(of_bytes.hexdigest())
            yield out

    rows = docs.select(F.col(key).cast("long").alias("k"), text_bytes(text).alias("t"))
    return map_batches(rows, run, SCHEMA)
