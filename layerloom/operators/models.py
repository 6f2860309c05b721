"""The models of the three layers above raw tables, compiled to DataFrames.

Each function takes the inputs' DataFrames and schemas and returns a DataFrame and its schema. Nothing is executed but
barriers: after steps that may raise and before steps that could hide it (see layerloom.barrier).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerloom.barrier import barrier as eager
from layerloom.functions.cleaning import chain_can_fail, clean
from layerloom.functions.expressions import all_hold, can_overflow, condition, expression, name
from layerloom.functions.metrics import metric, metric_type
from layerloom.spec import model as m
from layerloom.types import SPARK_TYPES, Schema

Built = tuple[DataFrame, Schema]
Barrier = Callable[[DataFrame], DataFrame]
#: No identifier of the language starts with an underscore.
_RANK = "_rank"


def first_of_each(df: DataFrame, keys: tuple[str, ...], order_by: tuple[m.SortKey, ...]) -> DataFrame:
    """The first row of each key by the order, nulls last either way; null keys are equal to each other.

    Only one row a key and task is shuffled: Spark limits ranked groups before the exchange.
    """
    order = [name(k.column).asc_nulls_last() if k.direction == "asc" else name(k.column).desc_nulls_last() for k in order_by]
    ranked = df.withColumn(_RANK, F.row_number().over(Window.partitionBy(*map(name, keys)).orderBy(*order)))
    return ranked.filter(F.col(_RANK) == 1).drop(_RANK)


def staging(model: m.StagingModel, source: DataFrame, schema: Schema, barrier: Barrier = eager) -> Built:
    """Projection with column operations, then filters and deduplications in their order."""
    found = [(c, *clean(name(c.source), schema[c.source], c.operations, f"{model.name}.{c.target}")) for c in model.columns]
    df = source.select(*[x.alias(c.target) for c, x, _ in found])
    out = {c.target: kind for c, _, kind in found}
    if model.row_operations and any(chain_can_fail(schema[c.source], c.operations) for c in model.columns):
        df = barrier(df)
    for op in model.row_operations:
        df = df.filter(condition(op.condition, out)) if isinstance(op, m.FilterRows) else first_of_each(df, op.keys, op.order_by)
    return df, out


def _derive(df: DataFrame, schema: Schema, model: m.Transform | m.JoinModel, barrier: Barrier) -> Built:
    """Derived columns over the projected ones only, all at once, then filters over both."""
    out = schema | {d.name: d.type for d in model.derived_columns}
    if model.derived_columns:
        derived = [expression(d.expression, schema).cast(SPARK_TYPES[d.type]).alias(d.name) for d in model.derived_columns]
        df = df.select(*map(name, schema), *derived)
        if model.filters and any(can_overflow(d.expression, schema) for d in model.derived_columns):
            df = barrier(df)
    return (df.filter(all_hold(model.filters, out)) if model.filters else df), out


def transform(model: m.Transform, source: DataFrame, schema: Schema, barrier: Barrier = eager) -> Built:
    projected = source.select(*[name(c.source).alias(c.target) for c in model.columns])
    return _derive(projected, {c.target: schema[c.source] for c in model.columns}, model, barrier)


def join(model: m.JoinModel, left: Built, right: Built, barrier: Barrier = eager) -> Built:
    """An inner or left equi-join; null keys match nothing. Both sides are renamed first, so shared ancestry is no ambiguity."""
    sides = {"left": left, "right": right}
    needed = {
        side: sorted({c.source for c in model.columns if c.side == side} | {getattr(k, side) for k in model.join.on}) for side in sides
    }
    inner = {side: df.select(*[name(c).alias(f"_{side}_{c}") for c in needed[side]]) for side, (df, _) in sides.items()}
    on = reduce(and_, [F.col(f"_left_{k.left}") == F.col(f"_right_{k.right}") for k in model.join.on])
    joined = inner["left"].join(inner["right"], on, model.join.type)
    projected = joined.select(*[F.col(f"_{c.side}_{c.source}").alias(c.target) for c in model.columns])
    return _derive(projected, {c.target: sides[c.side][1][c.source] for c in model.columns}, model, barrier)


def aggregate(model: m.Aggregate | m.OutputModel, source: DataFrame, schema: Schema) -> Built:
    """Filters over source names, then groups (null is one) and metrics."""
    df = source.filter(all_hold(model.filters, schema)) if model.filters else source
    keys: list[Column] = [name(c.source).alias(c.target) for c in model.group_by]
    out = {c.target: schema[c.source] for c in model.group_by} | {x.name: metric_type(x, schema) for x in model.metrics}
    # Names of groups and of metrics' columns may clash: group by hidden names first.
    hidden = df.select(*[k.alias(f"_by_{c.target}") for k, c in zip(keys, model.group_by, strict=True)], *map(name, schema))
    grouped = hidden.groupBy(*[F.col(f"_by_{c.target}").alias(c.target) for c in model.group_by])
    return grouped.agg(*[metric(x, schema) for x in model.metrics]).select(*map(name, out)), out


def deduplicate(model: m.Deduplicate, source: DataFrame, schema: Schema) -> Built:
    return first_of_each(source, model.keys, model.order_by).select(*map(name, schema)), dict(schema)


def build(model: m.StagingModel | m.Intermediate | m.OutputModel, inputs: dict[str, Built], barrier: Barrier = eager) -> Built:
    """The DataFrame and schema of any model; inputs holds what it reads, by name."""
    match model:
        case m.StagingModel():
            return staging(model, *inputs[model.source], barrier)
        case m.Transform():
            return transform(model, *inputs[model.source], barrier)
        case m.JoinModel():
            return join(model, inputs[model.left], inputs[model.right], barrier)
        case m.Deduplicate():
            return deduplicate(model, *inputs[model.source])
    return aggregate(model, *inputs[model.source])


__all__ = ["aggregate", "build", "deduplicate", "first_of_each", "join", "staging", "transform"]
