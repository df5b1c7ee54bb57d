"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, shuffle_partitions: int = 8, checkpoint_dir: str | None = None) -> SparkSession:
    """A local session for tests and the bench."""
    conf = {"spark.checkpoint.dir": checkpoint_dir} if checkpoint_dir else {}
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sparquill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARQUILL_DRIVER_MEMORY", "12g"))
        .config(map=conf)
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it runs from a checkout.

    On a cluster pass the package with --py-files; this only covers workers that
    share the driver's file system.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """One process, so that any folder is shared; local-cluster isn't."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one where that is unset, in local mode only."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not is_local(spark):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


@lru_cache(maxsize=8)
def _own_dir(_application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="sparquill-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder, read back: its plan runs once and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
