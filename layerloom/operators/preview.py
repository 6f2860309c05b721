"""Small looks at whole tables: a preview, a row count and an order-free checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.functions.expressions import name

ROWS, WIDTH = 5, 40


def top(df: DataFrame, grain: tuple[str, ...], rows: int = ROWS) -> DataFrame:
    """The first rows by the grain, nulls last: a top-k, never a full sort."""
    return df.orderBy(*[name(c).asc_nulls_last() for c in grain]).limit(rows)


def cell(value: object) -> str:
    text = "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return text if len(text) <= WIDTH else text[: WIDTH - 1] + "…"


def preview(df: DataFrame, grain: tuple[str, ...], rows: int = ROWS) -> list[list[str]]:
    """A header and up to `rows` rows of short cells."""
    return [df.columns, *[[cell(v) for v in row] for row in top(df, grain, rows).collect()]]


def checksum(df: DataFrame) -> tuple[int, str]:
    """The number of rows and a sum over their hashes: equal for equal bags of rows in any order, repeats included."""
    columns = [x for c in df.columns for x in (F.coalesce(name(c).cast("string"), F.lit("")), name(c).isNull())]
    digest = F.xxhash64(*columns) if columns else F.lit(0)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(digest.cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], str(row["sum"] or 0)
