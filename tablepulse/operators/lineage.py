"""Where results of a step are written, so that what follows reads them and doesn't compute them again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On a single machine, as in tests, one of our own will do."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: every later job reads the same rows in the same partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
