"""Places of rows in a global order, and sums ahead of them, from the totals of partitions.

number_rows(rows, order) deals rows into ranges of the order, sorts each range and lets
every task count its own rows (and sum their weights) from zero, anew for each group.
The ranges are written with these local figures; what lies ahead of a range is the sum
of the totals of the ranges before it, a table of one row per range and group. So a
group of any size is spread over tasks and no window ever holds it.

The ranges are cut by the order and last by a number of each input row: rows that tie
in the whole order, however many, are spread over ranges too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sparquill.llm.common import store


def _count(batches: Iterator[pa.RecordBatch], group: str | None, weight: str | None) -> Iterator[pa.RecordBatch]:
    task, at, before, last = TaskContext.get().partitionId(), 0, 0, None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ahead = np.concatenate([[0], np.cumsum(b.column(weight).to_numpy(zero_copy_only=False))]).astype(np.int64) if weight else np.zeros(n + 1, np.int64)
        starts = np.full(n, -at, np.int64)  # where the row's run began; before this batch: negative
        base = np.full(n, -before, np.int64)
        if group:
            g = b.column(group)
            new = np.empty(n, bool)
            new[0] = last is not None and g[0].as_py() != last
            new[1:] = pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            run = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            starts = np.where(run < 0, starts, run)
            base = np.where(run < 0, base, ahead[np.maximum(run, 0)])
            last = g[n - 1].as_py()
        places, sums = np.arange(n) - starts, ahead[:-1] - base
        at, before = int(places[-1]) + 1, int(ahead[-1] - base[-1])
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(n, task, np.int32)), pa.array(places), pa.array(sums)],
            names=[*b.schema.names, "task", "at", "before"],
        )


def number_rows(rows: DataFrame, order: Sequence[str], group: str | None = None, weight: str | None = None) -> DataFrame:
    """rows with at (place from 0), before (weights ahead), n_rows and total (of all rows), each within the row's group.

    order begins with the group, a string column without nulls; weight is a long
    column without nulls. Nulls come first. rows is written once, so its plan runs once.
    """
    kind = StructType([*rows.schema.fields, StructField("task", IntegerType()), StructField("at", LongType()), StructField("before", LongType())])
    rows = store(rows.withColumn("spread", F.monotonically_increasing_id()), "unnumbered")
    dealt = rows.repartitionByRange(*order, "spread").sortWithinPartitions(*order, "spread").drop("spread")
    local = store(dealt.mapInArrow(lambda batches: _count(batches, group, weight), kind), "numbered")

    by = [group] if group else []
    w = F.col(weight) if weight else F.lit(0)
    totals = local.groupBy("task", *by).agg(F.count("*").alias("n"), F.sum(w).cast("long").alias("w"))
    # one row per range and group it holds: as many as ranges and groups together
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    of_all = Window.partitionBy(*by, F.lit(0))
    ahead = totals.select(
        "task", *by,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_ahead"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w_ahead"),
        F.sum("n").over(of_all).alias("n_rows"), F.sum("w").over(of_all).alias("total"),
    )
    found = local.join(store(ahead, "ranges"), ["task", *by])
    return found.select(*rows.drop("spread").columns, (F.col("at") + F.col("n_ahead")).alias("at"), (F.col("before") + F.col("w_ahead")).alias("before"), "n_rows", "total")
