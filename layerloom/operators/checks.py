"""Assertions as queries that return the rows which violate them; an assertion holds if there are none."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.functions.expressions import name
from layerloom.spec import model as m
from layerloom.types import literal


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(name(column).isNull())


def unique(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once, with their count; rows with a null in the key don't count."""
    full = df.filter(reduce(and_, [name(c).isNotNull() for c in columns]))
    return full.groupBy(*map(name, columns)).agg(F.count(F.lit(1)).alias("n_records")).filter("n_records > 1")


def relationships(child: DataFrame, columns: tuple[str, ...], parent: DataFrame, to_columns: tuple[str, ...]) -> DataFrame:
    """Child keys without a parent. Keys that are wholly null are left out; partly null ones match nothing."""
    keys = child.select(*[name(c).alias(f"_child_{i}") for i, c in enumerate(columns)])
    some = reduce(lambda a, b: a | b, [F.col(f"_child_{i}").isNotNull() for i in range(len(columns))])
    universe = parent.select(*[name(c).alias(f"_parent_{i}") for i, c in enumerate(to_columns)]).distinct()
    on = reduce(and_, [F.col(f"_child_{i}") == F.col(f"_parent_{i}") for i in range(len(columns))])
    lost = keys.filter(some).join(universe, on, "left_anti")
    return lost.select(*[F.col(f"_child_{i}").alias(f"key_{i + 1}") for i in range(len(columns))])


def accepted_values(df: DataFrame, column: str, values: tuple) -> DataFrame:
    return df.filter(name(column).isNotNull() & ~name(column).isin(*[literal(v) for v in values]))


def row_count(df: DataFrame, least: int | None, most: int | None) -> DataFrame:
    """One row with the count if it is out of bounds."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    low = F.col("n_rows") < least if least is not None else F.lit(False)
    high = F.col("n_rows") > most if most is not None else F.lit(False)
    return counted.filter(low | high)


def column_range(df: DataFrame, column: str, least, most, inclusive: bool = True) -> DataFrame:
    x, out = name(column), F.lit(False)
    if least is not None:
        out = out | (x < literal(least) if inclusive else x <= literal(least))
    if most is not None:
        out = out | (x > literal(most) if inclusive else x >= literal(most))
    return df.filter(x.isNotNull() & out)


def violations(assertion: m.Assertion, tables: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
    """(check name, violating rows) of an assertion; one check for each column of not_null."""
    df = tables[assertion.model]
    match assertion:
        case m.NotNull():
            return [(check_name(f"{assertion.name}__{c}" if len(assertion.columns) > 1 else assertion.name), not_null(df, c)) for c in assertion.columns]
        case m.Unique():
            found = unique(df, assertion.columns)
        case m.References():
            found = relationships(df, assertion.columns, tables[assertion.to_model], assertion.to_columns)
        case m.AcceptedValues():
            found = accepted_values(df, assertion.column, assertion.values)
        case m.RowsBetween():
            found = row_count(df, assertion.min, assertion.max)
        case m.ColumnRange():
            found = column_range(df, assertion.column, assertion.min, assertion.max, assertion.inclusive)
    return [(check_name(assertion.name), found)]


def row_checks(assertions: list[m.Assertion], tables: dict[str, DataFrame]) -> dict[str, int]:
    """Violations of all assertions of one table that look at single rows or the count, in one pass over it."""
    counts, model = {}, assertions[0].model
    for a in assertions:
        match a:
            case m.NotNull():
                for c in a.columns:
                    counts[check_name(f"{a.name}__{c}" if len(a.columns) > 1 else a.name)] = F.count(F.when(name(c).isNull(), 1))
            case m.AcceptedValues():
                counts[check_name(a.name)] = F.count(F.when(name(a.column).isNotNull() & ~name(a.column).isin(*[literal(v) for v in a.values]), 1))
            case m.RowsBetween():
                n = F.count(F.lit(1))
                out = (n < (a.min if a.min is not None else 0)) | (n > a.max if a.max is not None else F.lit(False))
                counts[check_name(a.name)] = F.when(out, 1).otherwise(0)
            case m.ColumnRange():
                x, out = name(a.column), F.lit(False)
                if a.min is not None:
                    out = out | (x < literal(a.min) if a.inclusive else x <= literal(a.min))
                if a.max is not None:
                    out = out | (x > literal(a.max) if a.inclusive else x >= literal(a.max))
                counts[check_name(a.name)] = F.count(F.when(out, 1))
    row = tables[model].agg(*[c.cast("bigint").alias(f"_{i}") for i, c in enumerate(counts.values())]).first()
    return dict(zip(counts, row, strict=True))


SINGLE_ROW = (m.NotNull, m.AcceptedValues, m.RowsBetween, m.ColumnRange)


def check_name(name: str) -> str:
    """A name of at most 64 characters; a longer one ends with a part of its hash."""
    return name if len(name) <= 64 else f"{name[:55]}_{hashlib.sha256(name.encode()).hexdigest()[:8]}"
