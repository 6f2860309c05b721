"""Helpers shared by the corpus operators: durable cuts of lineage and sizes of work."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one task holds at a time.
BLOCK_BYTES = 4 << 20
#: Bytes of a partition below which partitions are joined before they are kept.
TASK_BYTES = 8 << 20
#: Bytes of rows that go to or come from Python at a time.
BATCH_BYTES = 4 << 20
#: Bytes of a partition, as measured, up to which a hash table of it is built.
HASH_BYTES = "16m"


def cut(df: DataFrame, size: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """df, computed and kept in the shared checkpoint folder: a lost executor costs no recomputation, lineage ends here.

    size: the bytes that df has, about. Where the session's partitions are smaller than task_bytes they are joined, for
    fewer files; larger ones stay, so no task grows with the data.

    The folder is the one spark.checkpoint.dir names; only a local session without it gets a temporary one, which goes
    with the process.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="layerloom-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return (df if size is None else df.coalesce(max(1, -(-size // task_bytes)))).checkpoint(eager=True)


def bound_batches(spark: SparkSession) -> None:
    """Bounds what goes to and comes from Python at a time in bytes, not only in rows; a smaller bound is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def batched(df: DataFrame, func: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(func, schema) with bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(func, schema)


@contextlib.contextmanager
def hash_joins(spark: SparkSession) -> Iterator[None]:
    """Within it, adaptive execution may join by hashing, without sorting either side, where every partition of one is small."""
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(key)
    if before in ("0", "0b"):
        spark.conf.set(key, HASH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def packed_row(df: DataFrame, columns: list[str]) -> Column:
    """The columns as one struct whose fields may all be null, so that it comes back from Python with the same type."""
    kind = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")).schema["row"].dataType.simpleString()
    return F.struct(*[F.col(f"`{c}`") for c in columns]).cast(kind).alias("row")


def text_bytes(df: DataFrame, text: str) -> int:
    """The bytes of all texts of df, and some for each row."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)) + F.lit(64))).first()[0] or 0)


def held_out(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
