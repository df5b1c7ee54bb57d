"""A training-data pipeline: toxicity, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparquill.llm import langid, packing, simhash, toxicity
from sparquill.llm.common import crc32_of, store
from sparquill.llm.queries import vocabulary
from sparquill.session import ship, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain trained on the labelled rows predicts toxic go."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").where(crc32_of("doc_id") % 5 != 0)
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    ship(spark)
    return langid.keep_determined(docs, langid.train(docs.where(crc32_of("doc_id") % 4 != 2)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    ship(spark)
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' token pieces, packed into sequences."""
    ship(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language_id", drop_undetermined),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: Trained models, XXH64 fingerprints and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
