"""The folder that driver and executors share, for what is written between jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.errors import StorageError

#: Where a session without executors of its own writes if it names no folder.
ONE_MACHINE = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, as ``spark.checkpoint.dir`` names it; only a local session may do without that setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise StorageError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(folder or ONE_MACHINE)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a later failure reads it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
