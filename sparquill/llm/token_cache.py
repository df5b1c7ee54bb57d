"""Token counts through a digest cache.

count_tokens(docs, tokenizer_file, cache_path) joins (content digest, tokenizer
digest) to stored counts, encodes only distinct misses and appends them to the
cache, a Parquet table (content, tokenizer, n_tokens).

Content is normalised as far as the tokenizer ignores differences: null becomes
empty, and the digest is SHA-256 over the UTF-8 bytes as they are, since the
byte-level tokenizer tells every byte apart. The tokenizer digest covers the
vocabulary file and the library's version, so a new version misses the old counts.

Plan: digests are counted first and those the cache has are taken out. A miss that one
row has is encoded where the row lies; texts of misses that several rows have are made
distinct in each task and moved by digest, so that each is encoded once. Which way a row
goes is told by at most `SLOTS` hash slots of repeated misses, which are broadcast; a row
that merely shares a slot is moved as well, so the bound costs time, never results. Thin
(id, length, digest) rows are joined to the counts by digest, which Spark's skew join can
split where one text fills a large part of the table.

Counting follows the library: a text is cut where white space follows something
else, which is always a boundary of the byte-level pre-tokenizer and never lies
inside a special string; counts of the pieces add up to the text's count, and
pieces repeat, so each task keeps a bounded table of their counts.

Defined results: null and empty texts have 0 tokens; repeated rows and null ids
give a row each; other columns are ignored; an empty table gives an empty table
and appends nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import CHUNK, Batch, ByMiss, fresh_dir, map_batches, store, text_bytes

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
SLOTS = 1 << 20


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """A tokenizer of the tokenizers library, single-threaded, with no truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def tokenizer_digest(path: str) -> str:
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0" + tokenizers.__version__.encode()).hexdigest()


def counter(path: str):
    """text -> number of tokens, equal to the library's for byte-level tokenizers."""
    t = load_tokenizer(path)
    known = ByMiss(lambda piece: len(t.encode(piece, add_special_tokens=False).ids))
    return lambda text: sum(map(known.__getitem__, CHUNK.findall(text)))


def encode_texts(texts: DataFrame, tokenizer_file: str) -> DataFrame:
    """(content, text) rows to (content, n_tokens); within a task each content is encoded once."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        count = counter(tokenizer_file)
        for b in _distinct(batches):
            yield {"content": b["content"], "n_tokens": [count(t.decode("utf-8", "replace")) for t in b["text"]]}

    return map_batches(texts, run, "content binary, n_tokens long")


def _distinct(batches: Iterator[Batch], most: int = 1_000_000) -> Iterator[Batch]:
    """Rows of a task whose content it hasn't seen."""
    seen: set[bytes] = set()
    for b in batches:
        out: Batch = {"content": [], "text": []}
        for content, text in zip(b["content"], b["text"], strict=True):
            if content not in seen:
                if len(seen) >= most:
                    seen.clear()
                seen.add(content)
                out["content"].append(content)
                out["text"].append(text)
        yield out


def fill_cache(docs: DataFrame, tokenizer_file: str, cache_path: str, text: str = "text", slots: int = SLOTS) -> int:
    """Encode the distinct contents that the cache lacks, append them, and give how many there were."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_file)
    raw = text_bytes(text)
    digest = F.unhex(F.sha2(raw, 256))
    cached = _cache(spark, cache_path).where(F.col("tokenizer") == version).select("content")
    slot = F.pmod(F.xxhash64("content"), F.lit(slots))
    held = docs.select(digest.alias("content")).groupBy("content").agg(F.count("*").alias("rows"))
    empty = cached.isEmpty()
    misses = store(held if empty else held.join(cached, "content", "left_anti"), "token-misses")
    n = misses.count()
    if not n:
        return 0
    texts = docs.select(digest.alias("content"), raw.alias("text"))
    if not empty:
        texts = texts.join(misses, "content", "left_semi").select("content", "text")
    texts = texts.withColumn("slot", slot)
    repeated = F.broadcast(store(misses.where("rows > 1").select(slot.alias("slot")).distinct(), "token-slots"))  # at most `slots` rows
    alone = texts.join(repeated, "slot", "left_anti").select("content", "text")
    shared = map_batches(texts.join(repeated, "slot", "left_semi").select("content", "text"), _distinct, "content binary, text binary")
    new = encode_texts(alone, tokenizer_file).unionByName(encode_texts(shared.repartition("content"), tokenizer_file))
    new.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    return n


def count_tokens(docs: DataFrame, tokenizer_file: str, cache_path: str | None = None, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: n_bytes, n_tokens and over_limit (n_tokens > limit); the cache gains the distinct misses.

    cache_path: a Parquet table of CACHE_SCHEMA in storage that all executors reach; a fresh one if None.
    """
    spark = docs.sparkSession
    path = cache_path or fresh_dir(spark, "token-cache")
    fill_cache(docs, tokenizer_file, path, text)
    raw = text_bytes(text)
    thin = docs.select(F.col(key).cast("long").alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), F.unhex(F.sha2(raw, 256)).alias("content"))
    # an append that was tried twice may have stored a count twice
    counts = _cache(spark, path).where(F.col("tokenizer") == tokenizer_digest(tokenizer_file)).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    found = thin.join(counts, "content", "left")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cache(spark, path: str) -> DataFrame:
    """The stored counts as of now: the files are listed here, before the append."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)
