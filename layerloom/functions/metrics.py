"""Aggregates of a group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from layerloom.functions.expressions import TypeMismatch, UnknownColumn, check_condition, condition, name
from layerloom.spec import model as m
from layerloom.types import DATE, FLOAT, INTEGER, NUMERIC, TIMESTAMP, Schema


def metric_type(metric: m.Metric, schema: Schema) -> str:
    """The type of a metric; raises if its column or condition doesn't fit."""
    column = getattr(metric, "column", None)
    if column is not None and column not in schema:
        raise UnknownColumn(column)
    match metric:
        case m.ConditionalCount() | m.ConditionalSum():
            check_condition(metric.condition, schema)
    match metric:
        case m.Sum() | m.Average() | m.ConditionalSum():
            if schema[column] not in NUMERIC:
                raise TypeMismatch("E126", f"{metric.function} needs a number, not {schema[column]}")
            return FLOAT
        case m.Minimum() | m.Maximum():
            if schema[column] not in (*NUMERIC, DATE, TIMESTAMP):
                raise TypeMismatch("E126", f"{metric.function} needs a number, date or timestamp, not {schema[column]}")
            return schema[column]
    return INTEGER


def _total(x: Column, kind: str) -> Column:
    """A sum as a double; integers are added exactly, beyond 64 bits too."""
    return F.sum(x.cast("decimal(20,0)")).cast("double") if kind == INTEGER else F.sum(x)


def metric(spec: m.Metric, schema: Schema) -> Column:
    metric_type(spec, schema)
    match spec:
        case m.CountRows():
            return F.count(F.lit(1)).alias(spec.name)
        case m.ConditionalCount():
            return F.count(F.when(condition(spec.condition, schema), F.lit(1))).alias(spec.name)
    x, kind = name(spec.column), schema[spec.column]
    match spec:
        case m.Count():
            out = F.count(x)
        case m.CountDistinct():
            out = F.countDistinct(x)
        case m.Sum():
            out = _total(x, kind)
        case m.Average():
            out = _total(x, kind) / F.nullif(F.count(x), F.lit(0)) if kind == INTEGER else F.avg(x)
        case m.Minimum():
            out = F.min(x)
        case m.Maximum():
            out = F.max(x)
        case m.ConditionalSum():
            out = _total(F.when(condition(spec.condition, schema), x), kind)
    return out.alias(spec.name)
