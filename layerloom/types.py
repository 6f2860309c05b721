"""The six column types of the pipeline language and their Spark forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, INTEGER, FLOAT, BOOLEAN, DATE, TIMESTAMP = "string", "integer", "float", "boolean", "date", "timestamp"
SPARK_TYPES: dict[str, T.DataType] = {
    STRING: T.StringType(),
    INTEGER: T.LongType(),
    FLOAT: T.DoubleType(),
    BOOLEAN: T.BooleanType(),
    DATE: T.DateType(),
    TIMESTAMP: T.TimestampType(),
}
NAMES = tuple(SPARK_TYPES)
NUMERIC = (INTEGER, FLOAT)

Schema = dict[str, str]
Scalar = str | int | float | bool


def struct_of(schema: Schema) -> T.StructType:
    return T.StructType([T.StructField(name, SPARK_TYPES[kind], True) for name, kind in schema.items()])


def scalar_type(value: Scalar) -> str:
    """The type of a literal; a boolean is never a number and 1 is not 1.0."""
    for kind, name in ((bool, BOOLEAN), (int, INTEGER), (float, FLOAT), (str, STRING)):
        if type(value) is kind:
            return name
    raise TypeError(f"not a scalar: {value!r}")


def literal(value: Scalar) -> Column:
    """A literal of exactly the type that its JSON form has."""
    return F.lit(value).cast(SPARK_TYPES[scalar_type(value)])


def same_shape(found: T.StructType, schema: Schema) -> bool:
    """Names, order and types agree; nullability is not part of a schema here."""
    return [(f.name, f.dataType) for f in found] == [(n, SPARK_TYPES[k]) for n, k in schema.items()]
