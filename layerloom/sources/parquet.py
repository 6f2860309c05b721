"""Parquet tables: written with exactly the declared columns, read only if the file has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layerloom.errors import StageError
from layerloom.functions.expressions import name
from layerloom.types import Schema, same_shape, struct_of

#: Rows of a table that go to one file, at most.
FILE_ROWS = 5_000_000


def write(df: DataFrame, path: str, schema: Schema) -> None:
    """Replaces the table at path. Each task writes what it has made: no work is drawn together for fewer files."""
    if extra := sorted(set(df.columns) - set(schema)):
        raise StageError("write", f"columns that aren't declared: {', '.join(extra)}")
    if missing := sorted(set(schema) - set(df.columns)):
        raise StageError("write", f"columns that are missing: {', '.join(missing)}")
    out = df.select(*map(name, schema))
    if not same_shape(out.schema, schema):
        raise StageError("write", f"types are {out.schema.simpleString()}, declared {struct_of(schema).simpleString()}")
    out.write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def read(spark: SparkSession, path: str, schema: Schema, rows: int | None = None) -> DataFrame:
    """The table at path; names, order, types and (if given) the number of rows must agree.

    The file's own schema is compared first: a schema that is merely imposed would fill a missing column with nulls.
    """
    df = spark.read.parquet(path)
    if not same_shape(df.schema, schema):
        raise StageError("load", f"{path} has {df.schema.simpleString()}, declared {struct_of(schema).simpleString()}")
    if rows is not None and (found := df.count()) != rows:
        raise StageError("load", f"{path} has {found} rows, not {rows}")
    return df
