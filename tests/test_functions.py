import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from layerloom.functions.casts import cast
from layerloom.functions.cleaning import clean, lower, upper
from layerloom.functions.dates import spark_pattern
from layerloom.functions.expressions import condition, expression
from layerloom.spec import model as m
from layerloom.spec.shapes import Object


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    found.execute("SET timezone = 'UTC'")
    return found


def one(spark, kind, value, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def both(spark, duck, kind, value, source, target, sql_kind):
    """(whether it works, the value) in either engine."""
    try:
        mine = (True, one(spark, kind, value, lambda x: cast(x, source, target)))
    except Exception:
        mine = (False, None)
    try:
        theirs = (True, duck.execute(f"SELECT CAST(CAST(? AS {'VARCHAR' if source == 'string' else 'DOUBLE'}) AS {sql_kind})", [value]).fetchall()[0][0])
    except duckdb.Error:
        theirs = (False, None)
    return mine, theirs


TEXTS = ["2.5", "3.5", "-2.5", "2.4999", " 5 ", "1e3", "+5", ".5", "5.", "1_000", "abc", "", "1__0", "_10", "1.5f", "1.5d", "1e-1", "9223372036854775807", "9223372036854775808", "nan", "inf", "-Infinity", "1e400", "0.4999999999999999999", "-0.4999999999999999999", "0.5000000000000000001", "-.5", "9223372036854775806.5", "00012.50", "+.49"]
TEXTS += [" true ", "true", "T", "on", "no", "Y", "1", "0", "2024-01-05", "2024/1/5", "2024", "2024-01", "2024-1-5", " 2024-01-05 ", "2024-01-05 10:00:00", "2024-02-30"]


@pytest.mark.parametrize("target,sql", [("integer", "BIGINT"), ("float", "DOUBLE"), ("boolean", "BOOLEAN"), ("date", "DATE")])
def test_strings_are_read_alike(spark, duck, target, sql):
    for text in TEXTS:
        if target == "date" and text in ("inf", "-Infinity"):
            continue  # no infinite dates here
        mine, theirs = both(spark, duck, "string", text, "string", target, sql)
        assert mine[0] == theirs[0] and str(mine[1]) == str(theirs[1]), (text, mine, theirs)


def test_doubles_are_rounded_and_written_alike(spark, duck):
    for x in (2.5, 3.5, -2.5, 2.7, 0.5, 1e19):
        mine, theirs = both(spark, duck, "double", x, "float", "integer", "BIGINT")
        assert mine == theirs
    for x in (0.0, 1.0, 1e16, 123456789.125, 1e-4, 0.00012, 1e-5, 1.5e300, 1e15, 9.5e15, -2.5, 1e7, 12345678.9, 1e22, 0.001, -1e-3, 123e10, 100.0, -12345678912.0, math.nan, -math.inf):
        mine, theirs = both(spark, duck, "double", x, "float", "string", "VARCHAR")
        assert mine == theirs


def test_other_casts(spark):
    assert one(spark, "boolean", True, lambda x: cast(x, "boolean", "string")) == "true"
    assert one(spark, "bigint", 7, lambda x: cast(x, "integer", "boolean")) is True
    assert one(spark, "string", "2024-01-05 10:00:00.12+02:00", lambda x: cast(cast(x, "string", "timestamp"), "timestamp", "string")) == "2024-01-05 08:00:00.12+00"
    assert one(spark, "string", None, lambda x: cast(x, "string", "integer")) is None
    for source, target in (("timestamp", "integer"), ("date", "float"), ("integer", "date"), ("date", "boolean")):
        with pytest.raises(TypeError):
            cast(F.col("x"), source, target)


@pytest.mark.parametrize(
    "text,fmt,day",
    [("20240105", "%Y%m%d", dt.date(2024, 1, 5)), ("5.1.2024", "%d.%m.%Y", dt.date(2024, 1, 5)), ("2024-1-5", "%Y-%m-%d", dt.date(2024, 1, 5)), ("Jan 5, 2024", "%b %d, %Y", dt.date(2024, 1, 5)), ("day 05 of 01'2024", "day %d of %m'%Y", dt.date(2024, 1, 5))],
)
def test_formats(spark, duck, text, fmt, day):
    assert one(spark, "string", text, lambda x: cast(x, "string", "date", fmt)) == day
    assert duck.execute("SELECT CAST(strptime(?, ?) AS DATE)", [text, fmt]).fetchall()[0][0] == day
    with pytest.raises(Exception):
        one(spark, "string", "garbage", lambda x: cast(x, "string", "date", fmt))


def test_patterns_without_counterpart():
    assert spark_pattern("%Y-%m-%dT%H:%M:%S%z") == "yyyy-M-d'T'H:m:sZ"
    assert spark_pattern("%H%M") == "HHmm"
    assert spark_pattern("%F %T") == "yyyy-M-d H:m:s"
    for bad in ("%y", "%Q", "%"):
        with pytest.raises(ValueError):
            spark_pattern(bad)


def test_case_is_changed_letter_by_letter(spark, duck):
    text = "straße ﬁ ŉ İ ΑΣ ÄÖÜ äöü ǆ ΐ"
    assert (one(spark, "string", text, upper), one(spark, "string", text, lower)) == duck.execute("SELECT upper(?), lower(?)", [text, text]).fetchall()[0]


def ops(*specs):
    return tuple(m.COLUMN_OPERATION.read(s, "") for s in specs)


def test_cleaning_chains(spark):
    run = lambda value, *specs: one(spark, "string", value, lambda x: clean(x, "string", ops(*specs), "m.c")[0])
    assert run("  a\t", {"op": "trim"}) == "a\t"
    assert run("aaa", {"op": "replace", "old": "aa", "new": "b"}) == "ba"
    assert run("x{{ y }}'", {"op": "replace", "old": "{{ y }}", "new": "$1\\"}) == "x$1\\'"
    mapping = {"op": "map_values", "mapping": {"a": "", "": "b"}}
    assert [run(v, mapping) for v in ("a", "", "c", None)] == ["", "b", "c", None]
    assert [run(v, mapping | {"on_unmapped": "null"}) for v in ("a", "c", None)] == ["", None, None]
    assert run(None, mapping | {"on_unmapped": "error"}) is None
    with pytest.raises(Exception, match=r"unmapped value in m\.c") as e:
        run("secret", mapping | {"on_unmapped": "error"})
    assert "secret" not in str(e.value).splitlines()[0]
    assert [run(v, {"op": "null_if", "values": ["x", "y"]}, {"op": "coalesce", "value": "z"}) for v in ("x", "w", None)] == ["z", "w", "z"]
    assert run("007", {"op": "cast", "type": "integer"}, {"op": "null_if", "values": [7]}, {"op": "coalesce", "value": -1}, {"op": "cast", "type": "float"}) == -1.0


SCHEMA = {"i": "integer", "f": "float", "s": "string", "b": "boolean", "d": "date", "t": "timestamp"}
ROWS = [(1, 2.0, "x", True, dt.date(2024, 1, 7), dt.datetime(2024, 1, 1, 12)), (None, None, None, None, None, None), (2**63 - 1, 0.0, "", False, dt.date(2023, 12, 31), dt.datetime(2020, 2, 29))]


def evaluate(spark, node):
    df = spark.createDataFrame(ROWS, "i bigint, f double, s string, b boolean, d date, t timestamp")
    make = condition if isinstance(node, m.Condition) else expression
    return [r[0] for r in df.select(make(node, SCHEMA)).collect()]


def expr(**spec):
    return m.EXPRESSION.read(spec, "")


def col(c):
    return {"kind": "column", "column": c}


def lit(v):
    return {"kind": "literal", "value": v}


def test_arithmetic(spark):
    assert evaluate(spark, expr(kind="binary", operator="divide", left=col("i"), right=col("f"))) == [0.5, None, None]
    assert evaluate(spark, expr(kind="binary", operator="subtract", left=col("i"), right=lit(1))) == [0, None, 2**63 - 2]
    assert evaluate(spark, expr(kind="binary", operator="multiply", left=col("f"), right=lit(2))) == [4.0, None, 0.0]
    with pytest.raises(Exception, match="OVERFLOW"):
        evaluate(spark, expr(kind="binary", operator="add", left=col("i"), right=lit(1)))
    assert evaluate(spark, expr(kind="date_part", part="day_of_week", value=col("d"))) == [7, None, 7]
    assert evaluate(spark, expr(kind="date_part", part="quarter", value=col("t"))) == [1, None, 1]
    assert evaluate(spark, expr(kind="coalesce", values=[col("f"), col("i"), lit(5)])) == [2.0, 5.0, 0.0]


def test_three_valued_conditions(spark):
    cond = lambda **spec: m.CONDITION.read(spec, "")
    eq = {"kind": "comparison", "operator": "eq", "left": col("i"), "right": lit(1.0)}
    assert evaluate(spark, cond(**eq)) == [True, None, False]
    assert evaluate(spark, cond(kind="not", condition=eq)) == [False, None, True]
    assert evaluate(spark, cond(kind="in", value=col("s"), options=["x"], negated=True)) == [False, None, True]
    assert evaluate(spark, cond(kind="is_null", value=col("b"))) == [False, True, False]
    truth = {"kind": "is_null", "value": lit("x"), "negated": True}
    assert evaluate(spark, cond(kind="any", conditions=[eq, truth])) == [True, True, True]
    assert evaluate(spark, cond(kind="all", conditions=[eq, truth])) == [True, None, False]


def test_objects_read_back():
    spec = {"kind": "in", "value": col("s"), "options": ["x", 1], "negated": False}
    assert m.CONDITION.write(m.CONDITION.read(spec, "")) == spec
    assert Object(m.SortKey).read({"column": "a"}, "").direction == "asc"
