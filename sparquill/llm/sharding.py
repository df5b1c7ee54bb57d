"""Contiguous shards of near-equal bytes, by global prefix sums.

assign_shards(docs) orders documents by id, sums sizes ahead of each document from
per-partition totals (see numbering) and cuts the total at equal targets: a document
belongs to the shard its middle byte falls into. Shards are contiguous in the order
of ids, each is off its target by at most the largest document, and groups of
copies or of one id may be of any size, for a cut may fall inside them.

Ids are numbers; texts never move: the text is read once, and what is dealt is id, size
and checksum. write_shards(docs, path) moves the texts too, once, into one folder per
shard, in order.

Defined results: null texts count as empty, size 16; null ids come first; ties of ids
are ordered by size and checksum, and rows that tie in all three are alike in the
result; repeated rows are rows of their own; a document larger than a target may leave
shards without rows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import store, text_bytes
from sparquill.llm.numbering import number_rows

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def assign_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id", row_bytes: int = ROW_BYTES, keep: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard (from 0) and slot (place in the shard, from 0); and the columns of docs named in keep."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    data = text_bytes(text)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(data) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        *([F.struct(*keep).alias("kept")] if keep else []),
    )
    placed = number_rows(rows, ["doc_id", "size", "text_crc32"], weight="size")
    # 2 * shards * total may pass the range of a long, so the cut is made in decimals
    middle = "cast(2 * before + size as decimal(20, 0))"
    cut = placed.withColumn("shard", F.expr(f"cast(least(({middle} * {shards}) div cast(2 * total as decimal(20, 0)), {shards - 1}) as int)"))
    cut = store(cut.drop("before", "n_rows", "total"), "shards")
    firsts = cut.groupBy("shard").agg(F.min("at").alias("first"))
    # at most one row per shard
    slots = cut.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("at") - F.col("first"))
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot", *(["kept.*"] if keep else []))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text: str = "text", key: str = "doc_id", keep: Sequence[str] = ()) -> None:
    """Parquet folders path/shard=N with the id, size, checksum, slot, text and the columns in keep; rows of a file are in order of slot.

    Ranges are contiguous already, so no further shuffle is needed to write them.
    """
    placed = assign_shards(docs, shards, text, key, keep=[text, *(k for k in keep if k not in (text, key))])
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
