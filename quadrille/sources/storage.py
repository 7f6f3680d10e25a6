"""Cutting long plans, and the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where all is one machine, as in tests, may it be unset."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quadrille-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While it lasts, what a query shuffled goes from the disks when its rows are written. Spark otherwise keeps it until the driver
    happens to collect its garbage, so that the steps of a long job add up."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, path: str, *by: str) -> None:
    """Writes Parquet files: packed well, as keys in hexadecimal digits are most of the bytes, and nothing shuffled stays behind."""
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_base(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # a query of its own, as a frame's query has its settings from when it was made


def laid(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage as cut does, for rows that are many and repeat themselves: a Parquet table in the shared folder takes a fraction of a checkpoint's bytes, which are never compressed."""
    path = scratch(df.sparkSession, name)
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Writes a table in the shared folder and reads it back, with aggregates that are taken from the rows as they are written: no second pass counts them."""
    seen, path = Observation(name), scratch(df.sparkSession, name)
    df.observe(seen, *[m.alias(k) for k, m in metrics.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get
