"""Eager barriers: rows are computed and kept before anything downstream may be pushed into their plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one spark.checkpoint.dir names; only a local session without it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="layerloom-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def barrier(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the shared checkpoint folder.

    Without it a later filter or a column that nobody reads would keep a failing cast from being evaluated at all.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
