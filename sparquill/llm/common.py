"""Plumbing shared by the training-data operators: batches, shared storage, bytes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from sparquill.session import shared_dir

Batch = dict[str, list]

#: Rows that Python holds at once; Spark bounds the bytes of the batch they are cut from.
ROWS_AT_ONCE = 512


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(col: Column | str) -> Column:
    """A string column as UTF-8 bytes, null as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def map_batches(df: DataFrame, fn: Callable[[Iterator[Batch]], Iterable[Batch]], schema: str, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """mapInArrow over plain lists: fn gets {column: values} of at most `rows` rows and yields the same."""
    kind: StructType = _parse_datatype_string(schema)  # type: ignore[assignment]
    arrow = to_arrow_schema(kind)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[Batch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows).to_pydict()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(cut(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def filter_batches(docs: DataFrame, text: str, start: Callable[[], Callable[[list], list[bool]]], rows: int = ROWS_AT_ONCE) -> DataFrame:
    """The rows of docs, all columns, that a test of the text's bytes keeps; start() makes the test, once a task."""
    asked = docs.withColumn(text, F.col(text).cast("string").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                yield part.filter(pa.array(keep(part.column(text).to_pylist()), pa.bool_()))

    return asked.mapInArrow(run, asked.schema).withColumn(text, F.col(text).cast("string"))


def crc32_of(col: Column | str) -> Column:
    """crc32 of a value's decimal text, as a long."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary"))


# One run of Unicode white space, then one run of the rest. Python also counts
# U+001C..U+001F as space, the tokenizer libraries don't, so they are taken out.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


class ByMiss(dict):
    """A dict that computes what it lacks and starts anew when it is full."""

    def __init__(self, make: Callable[[Any], Any], most: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
