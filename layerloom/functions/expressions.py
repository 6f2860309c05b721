"""Typing of expressions and conditions, and their Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from layerloom.spec import model as m
from layerloom.types import BOOLEAN, DATE, FLOAT, INTEGER, NUMERIC, SPARK_TYPES, TIMESTAMP, Schema, literal, scalar_type

_COMPARE = {"eq": eq, "ne": ne, "lt": lt, "lte": le, "gt": gt, "gte": ge}
_PART: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "day": F.dayofmonth,
    "day_of_week": lambda x: F.weekday(x) + 1,  # Monday is 1
}


class TypeMismatch(TypeError):
    """An expression that has no type; code tells how it is reported."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class UnknownColumn(KeyError):
    """A column that isn't there."""


def columns_of(node: m.Expression | m.Condition) -> set[str]:
    """All columns that an expression or condition names."""
    match node:
        case m.ColumnRef():
            return {node.column}
        case m.Literal():
            return set()
        case m.Binary() | m.Comparison():
            return columns_of(node.left) | columns_of(node.right)
        case m.Coalesce():
            return set().union(*map(columns_of, node.values))
        case m.All() | m.AnyOf():
            return set().union(*map(columns_of, node.conditions))
        case m.Not():
            return columns_of(node.condition)
    return columns_of(node.value)


def _joint(kinds: list[str]) -> str | None:
    """The one type of several arms: equal, or float for integers and floats."""
    if len(set(kinds)) == 1:
        return kinds[0]
    return FLOAT if set(kinds) == set(NUMERIC) else None


def type_of(node: m.Expression, schema: Schema) -> str:
    match node:
        case m.ColumnRef():
            if node.column not in schema:
                raise UnknownColumn(node.column)
            return schema[node.column]
        case m.Literal():
            return scalar_type(node.value)
        case m.Binary():
            kinds = [type_of(node.left, schema), type_of(node.right, schema)]
            if not set(kinds) <= set(NUMERIC):
                raise TypeMismatch("E129", f"{node.operator} needs numbers, not {' and '.join(kinds)}")
            return FLOAT if node.operator == "divide" else _joint(kinds)
        case m.DatePart():
            if (kind := type_of(node.value, schema)) not in (DATE, TIMESTAMP):
                raise TypeMismatch("E129", f"{node.part} needs a date or timestamp, not {kind}")
            return INTEGER
        case m.Coalesce():
            kinds = [type_of(v, schema) for v in node.values]
            if (kind := _joint(kinds)) is None:
                raise TypeMismatch("E129", f"coalesce needs values of one type, not {', '.join(kinds)}")
            return kind
    raise TypeMismatch("E129", f"no such expression: {node!r}")


def check_condition(node: m.Condition, schema: Schema) -> None:
    """Raises if the condition can't be evaluated over the schema."""
    match node:
        case m.Comparison():
            kinds = [type_of(node.left, schema), type_of(node.right, schema)]
            if _joint(kinds) is None:
                raise TypeMismatch("E999", f"can't compare {kinds[0]} with {kinds[1]}")
        case m.In():
            kind = type_of(node.value, schema)
            for option in node.options:
                if _joint([kind, scalar_type(option)]) is None:
                    raise TypeMismatch("E130", f"option {option!r} is no {kind}")
        case m.IsNull():
            type_of(node.value, schema)
        case m.All() | m.AnyOf():
            for part in node.conditions:
                check_condition(part, schema)
        case m.Not():
            check_condition(node.condition, schema)


def name(column: str) -> Column:
    return F.col(f"`{column}`")


def expression(node: m.Expression, schema: Schema) -> Column:
    """The column of an expression; overflow raises, a division by null or zero is null."""
    kind = type_of(node, schema)
    match node:
        case m.ColumnRef():
            return name(node.column)
        case m.Literal():
            return literal(node.value)
        case m.DatePart():
            return _PART[node.part](expression(node.value, schema)).cast("bigint")
        case m.Coalesce():
            return F.coalesce(*[expression(v, schema).cast(SPARK_TYPES[kind]) for v in node.values])
    left, right = (expression(x, schema).cast(SPARK_TYPES[kind]) for x in (node.left, node.right))
    if node.operator == "divide":
        return F.when(right.isNotNull() & (right != F.lit(0.0)), left / right)
    return {"add": left + right, "subtract": left - right, "multiply": left * right}[node.operator]


def condition(node: m.Condition, schema: Schema) -> Column:
    """The three-valued column of a condition."""
    match node:
        case m.Comparison():
            kind = SPARK_TYPES[_joint([type_of(node.left, schema), type_of(node.right, schema)]) or BOOLEAN]
            return _COMPARE[node.operator](expression(node.left, schema).cast(kind), expression(node.right, schema).cast(kind))
        case m.In():
            kind = SPARK_TYPES[_joint([type_of(node.value, schema), *map(scalar_type, node.options)]) or BOOLEAN]
            found = expression(node.value, schema).cast(kind).isin(*[literal(v).cast(kind) for v in node.options])
            return ~found if node.negated else found
        case m.IsNull():
            value = expression(node.value, schema)
            return value.isNotNull() if node.negated else value.isNull()
        case m.Not():
            return ~condition(node.condition, schema)
    return reduce(and_ if isinstance(node, m.All) else or_, [condition(c, schema) for c in node.conditions])


def all_hold(conditions: tuple[m.Condition, ...], schema: Schema) -> Column:
    return reduce(and_, [condition(c, schema) for c in conditions])


def can_overflow(node: m.Expression, schema: Schema) -> bool:
    """Whether integer arithmetic in an expression may raise."""
    match node:
        case m.Binary():
            own = node.operator != "divide" and type_of(node, schema) == INTEGER
            return own or can_overflow(node.left, schema) or can_overflow(node.right, schema)
        case m.DatePart():
            return can_overflow(node.value, schema)
        case m.Coalesce():
            return any(can_overflow(v, schema) for v in node.values)
    return False
