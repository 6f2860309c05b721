"""Column operations of the staging layer, applied one after another."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from layerloom.functions.casts import allowed, can_fail, cast
from layerloom.functions.expressions import TypeMismatch
from layerloom.spec import model as m
from layerloom.types import DATE, SPARK_TYPES, STRING, TIMESTAMP, literal, scalar_type

#: Letters without an upper-case letter of their own: upper() leaves them as they are, but for these.
_GROWING = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if len(c.upper()) > 1 and c != "ß")
_HIDDEN = "".join(chr(0xE000 + i) for i in range(len(_GROWING)))


def upper(x: Column) -> Column:
    """Upper case letter by letter: the length never changes and a sharp s becomes its capital."""
    plain = F.upper(F.replace(x, F.lit("ß"), F.lit("ẞ")))
    kept = F.translate(F.upper(F.translate(x, "ß" + _GROWING, "ẞ" + _HIDDEN)), _HIDDEN, _GROWING)
    return F.when(F.char_length(plain) == F.char_length(x), plain).otherwise(kept)


def lower(x: Column) -> Column:
    """Lower case letter by letter, whatever stands around."""
    return F.lower(F.replace(F.replace(x, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def result_type(kind: str, op: m.ColumnOperation) -> str:
    """The type after an operation; raises TypeMismatch if it doesn't take the type before."""
    match op:
        case m.Cast():
            if op.type in (DATE, TIMESTAMP) and kind != STRING:
                raise TypeMismatch("E120", f"a cast to {op.type} needs a string, not {kind}")
            return op.type
        case m.NullIf() | m.FillNull():
            for value in op.values if isinstance(op, m.NullIf) else (op.value,):
                if scalar_type(value) != kind:
                    raise TypeMismatch("E120", f"{value!r} is no {kind}")
            return kind
    if kind != STRING:
        raise TypeMismatch("E120", f"{op.op} needs a string, not {kind}")
    return kind


def chain_type(kind: str, operations: tuple[m.ColumnOperation, ...]) -> str:
    for op in operations:
        kind = result_type(kind, op)
    return kind


def chain_can_fail(kind: str, operations: tuple[m.ColumnOperation, ...]) -> bool:
    """Whether some value may make the chain raise."""
    for op in operations:
        if isinstance(op, m.MapValues) and op.on_unmapped == "error":
            return True
        if isinstance(op, m.Cast) and (can_fail(kind, op.type) or not allowed(kind, op.type) or op.format is not None):
            return True
        kind = result_type(kind, op)
    return False


def _map_values(x: Column, op: m.MapValues, where: str) -> Column:
    pairs = F.create_map(*[F.lit(y) for pair in op.mapping for y in pair])
    mapped = F.try_element_at(pairs, x)
    if op.on_unmapped == "keep":
        return F.coalesce(mapped, x)
    if op.on_unmapped == "null":
        return mapped
    wrong = F.raise_error(F.lit(f"unmapped value in {where}")).cast("string")  # never the value itself
    return F.when(x.isNull() | mapped.isNotNull(), mapped).otherwise(wrong)


def clean(x: Column, kind: str, operations: tuple[m.ColumnOperation, ...], where: str) -> tuple[Column, str]:
    """The column after all operations, and its type."""
    for op in operations:
        after = result_type(kind, op)
        match op:
            case m.Cast():
                x = cast(x, kind, op.type, op.format)
            case m.Trim():
                x = F.trim(x)
            case m.Lower():
                x = lower(x)
            case m.Upper():
                x = upper(x)
            case m.Replace():
                x = F.replace(x, F.lit(op.old), F.lit(op.new))
            case m.MapValues():
                x = _map_values(x, op, where)
            case m.NullIf():
                x = F.when(x.isNull() | x.isin(*[literal(v) for v in op.values]), F.lit(None).cast(SPARK_TYPES[kind])).otherwise(x)
            case m.FillNull():
                x = F.coalesce(x, literal(op.value))
        kind = after
    return x, kind
