"""The language is batch only: whole models are built, and no operator keeps state between runs.

Row-local staging (projection, column operations and filters without deduplication) is ordinary Spark columns, so
`apply_rows` takes streaming DataFrames as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from layerloom.operators.models import staging
from layerloom.spec import model as m
from layerloom.types import Schema


def apply_rows(model: m.StagingModel, stream: DataFrame, schema: Schema) -> DataFrame:
    """The staging model over a stream; deduplication would need unbounded state and is refused."""
    if any(isinstance(op, m.DeduplicateRows) for op in model.row_operations):
        raise ValueError("deduplication isn't defined over a stream")
    return staging(model, stream, schema, barrier=lambda df: df)[0]
