"""What the corpus operators share: reading tables and cutting lineage."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.folders import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, kept in the shared folder of ``spark.checkpoint.dir``.

    A later failure then reads the files again instead of working through the whole plan.
    """
    return checkpointed(df)


def settled(df: DataFrame) -> DataFrame:
    """``cut``, after which the driver lets go of what led to it: Spark removes shuffle files once nothing names them."""
    spark, kept = df.sparkSession, cut(df)
    # a frame that only this call still holds keeps its plan's shuffles: Python lets go first, then the JVM
    del df
    gc.collect()
    spark._jvm.System.gc()
    return kept


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs meanwhile: of long texts, executor and Python each hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer where the frame has such a column, for a column that is added for a while."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(df: DataFrame, name: str, kind: str):
    """A column as ``kind``; a null of that type where the frame has no such column."""
    return df[name].cast(kind) if name in df.columns else F.lit(None).cast(kind)
