"""Strict casts between the six types: a value that has no counterpart raises, whatever a later filter would drop.

The spellings that are read and written are those of the language's casts, not Spark's: doubles round half to even
when they become integers, decimal strings half away from zero, and doubles are printed plainly from 1e-4 up to 1e16.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from layerloom.functions.dates import spark_pattern
from layerloom.types import BOOLEAN, DATE, FLOAT, INTEGER, NUMERIC, SPARK_TYPES, STRING, TIMESTAMP

_INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"
_DECIMAL = r"^\s*[+-]?(\d+(_\d+)*(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"
_TRUE, _FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
_DAY = r"^\s*\d{1,6}([-/])\d{1,2}\1\d{1,2}\s*$"
_DAY_AND_MORE = r"^\s*\d{1,6}([-/])\d{1,2}\1\d{1,2}([T ].*)?\s*$"


def allowed(source: str, target: str) -> bool:
    """Whether a cast can ever succeed; dates and timestamps are made from strings only and become strings only."""
    if target in (DATE, TIMESTAMP):
        return source == STRING or (source == TIMESTAMP and target == DATE) or source == target
    return source not in (DATE, TIMESTAMP) or target == STRING


def can_fail(source: str, target: str) -> bool:
    """Whether some value of the source type has no counterpart."""
    return source != target and (source == STRING or (source == FLOAT and target == INTEGER))


def _strictly(x: Column, ok: Column, value: Column, target: str) -> Column:
    wrong = F.raise_error(F.concat(F.lit("can't cast to "), F.lit(target))).cast(SPARK_TYPES[target])
    return F.when(x.isNull(), F.lit(None).cast(SPARK_TYPES[target])).when(ok, value).otherwise(wrong)


def float_text(x: Column) -> Column:
    """A double as text: 10000000.0, 0.0001, 1e+16, 1.5e-07, nan, inf."""
    text = F.abs(x).cast("string")
    mantissa, power = F.regexp_extract(text, r"^([0-9.]+)E", 1), F.regexp_extract(text, r"E(-?\d+)$", 1)
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    n = F.when(power == "", F.lit(0)).otherwise(F.nullif(power, F.lit("")).cast("int"))
    whole = F.concat(F.rpad(digits, F.greatest(n + 1, F.lit(1)), "0"), F.lit(".0"))
    parted = F.concat(F.substring(digits, F.lit(1), n + 1), F.lit("."), F.substring(digits, n + 2, F.lit(400)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-n - 1, F.lit(0))), digits)
    exponent = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.when(n < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(n).cast("string"), F.greatest(F.length(F.abs(n).cast("string")), F.lit(2)), "0"))
    plain = (
        F.when(~F.contains(text, F.lit("E")), text)  # most: no pattern is tried
        .when((n >= 0) & (n < 16), F.when(F.length(digits) <= n + 1, whole).otherwise(parted))
        .when((n < 0) & (n >= -4), small)
        .otherwise(exponent)
    )
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit(""))
    return F.when(x.isNull(), None).when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, plain))


def _to_string(x: Column, source: str) -> Column:
    if source == FLOAT:
        return float_text(x)
    if source == TIMESTAMP:
        return F.concat(x.cast("string"), F.lit("+00"))
    return x.cast("string")


def _rounded(bare: Column) -> Column:
    """A decimal string as an integer, rounded once: its first decimal digit tells, whatever follows."""
    digits = F.concat(F.lit("0"), F.regexp_extract(bare, r"^[+-]?(\d*)", 1)).cast("decimal(38,0)")
    up = F.when(F.regexp_extract(bare, r"\.(\d)", 1) >= "5", F.lit(1)).otherwise(F.lit(0))
    sign = F.when(F.startswith(bare, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))
    powered = F.contains(F.upper(bare), F.lit("E"))
    return F.when(powered, F.round(F.when(powered, bare).cast("decimal(38,18)"), 0).cast("bigint")).otherwise(((digits + up) * sign).cast("bigint"))


def _from_string(x: Column, target: str, fmt: str | None) -> Column:
    if fmt is not None:
        pattern = spark_pattern(fmt)
        return F.to_timestamp(x, pattern).cast("date") if target == DATE else F.to_timestamp(x, pattern)
    if target == STRING:
        return x
    bare = F.replace(F.trim(x), F.lit("_"), F.lit(""))
    if target == INTEGER:
        return F.when(x.rlike(_INTEGER), F.when(x.rlike(_INTEGER), bare).cast("bigint")).otherwise(
            _strictly(x, x.rlike(_DECIMAL), _rounded(F.when(x.rlike(_DECIMAL), bare)), target)
        )
    if target == FLOAT:
        fits = x.rlike(_DECIMAL) | x.rlike(_SPECIAL)
        return _strictly(x, fits, F.when(fits, bare).cast("double"), target)
    if target == BOOLEAN:
        low = F.lower(x)
        return _strictly(x, low.isin(*_TRUE, *_FALSE), low.isin(*_TRUE), target)
    fits = x.rlike(_DAY_AND_MORE)
    dashed = F.when(fits, F.regexp_replace(F.trim(x), r"^(\d+)/(\d+)/", "$1-$2-"))
    return _strictly(x, fits, dashed.cast(SPARK_TYPES[target]), target)


def cast(x: Column, source: str, target: str, fmt: str | None = None) -> Column:
    """x of type source as target. A cast that can never succeed is refused here."""
    if not allowed(source, target):
        raise TypeError(f"no cast from {source} to {target}")
    if fmt is not None and source != STRING:
        raise TypeError("a format goes with a string")
    if source == target and fmt is None:
        return x
    if target == STRING:
        return _to_string(x, source)
    if source == STRING:
        return _from_string(x, target, fmt)
    if source == FLOAT and target == INTEGER:
        return F.rint(x).cast("bigint")
    if source in NUMERIC and target == BOOLEAN:
        return x != F.lit(0)
    return x.cast(SPARK_TYPES[target])
