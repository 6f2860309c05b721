"""Registered queries: each operator of the language over the driver's tables, with an independent SQL oracle.

Every query compiles a specification object (as JSON would declare it) with the same functions that run pipelines.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerloom.barrier import shared_folder
from layerloom.cli import load
from layerloom.functions.expressions import condition, name
from layerloom.operators import checks, models
from layerloom.operators.preview import checksum, top
from layerloom.plans import resolve
from layerloom.run import prepare
from layerloom.sources import parquet, values
from layerloom.sources.counts import row_counts
from layerloom.sources.synthetic import synthesise
from layerloom.spec import document
from layerloom.spec import model as m
from layerloom.spec.shapes import Object
from layerloom.types import BOOLEAN, DATE, FLOAT, INTEGER, STRING, TIMESTAMP, Schema

_KINDS = {T.StringType: STRING, T.LongType: INTEGER, T.IntegerType: INTEGER, T.DoubleType: FLOAT, T.BooleanType: BOOLEAN, T.DateType: DATE, T.TimestampType: TIMESTAMP, T.TimestampNTZType: TIMESTAMP}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def source(spark: SparkSession, sf_dir: str, table: str) -> tuple[DataFrame, Schema]:
    """A table of the driver with 32-bit integers widened, and its schema in the language's types."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df = df.select(*[name(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegerType) else name(f.name) for f in df.schema])
    return df, {f.name: _KINDS[type(f.dataType)] for f in df.schema}


def _register(key: str, query: Query, sql: str | None) -> None:
    QUERIES[key] = query
    if sql:
        ORACLES[key] = sql


# Short forms of specifications.


def col(c: str) -> dict:
    return {"kind": "column", "column": c}


def lit(v: Any) -> dict:
    return {"kind": "literal", "value": v}


def binary(op: str, a: dict, b: dict) -> dict:
    return {"kind": "binary", "operator": op, "left": a, "right": b}


def part(p: str, c: str) -> dict:
    return {"kind": "date_part", "part": p, "value": col(c)}


def cmp(op: str, a: dict, b: dict) -> dict:
    return {"kind": "comparison", "operator": op, "left": a, "right": b}


def isin(a: dict, options: list, negated: bool = False) -> dict:
    return {"kind": "in", "value": a, "options": options, "negated": negated}


def null(a: dict, negated: bool = False) -> dict:
    return {"kind": "is_null", "value": a, "negated": negated}


def _same(columns: list[str]) -> list[dict]:
    return [{"source": c, "target": c} for c in columns]


def _staging(key: str, table: str, columns: list, sql: str, rows: tuple = (), grain: tuple = ()) -> None:
    """columns: names, or (source, target, operations)."""
    spec = [{"source": c, "target": c} if isinstance(c, str) else {"source": c[0], "target": c[1], "operations": c[2]} for c in columns]
    model = Object(m.StagingModel).read({"name": key, "source": table, "columns": spec, "row_operations": list(rows), "grain": list(grain) or [spec[0]["target"]]}, "")
    _register(key, lambda spark, d: models.staging(model, *source(spark, d, table))[0], sql)


def _transform(key: str, table: str, columns: list[str], derived: list[tuple[str, str, dict]], filters: list[dict], sql: str, before: list | None = None) -> None:
    """before: staging columns to prepare the table with (for nulls)."""
    spec = {"operation": "transform", "name": key, "source": table, "columns": _same(columns), "grain": columns[:1], "filters": filters}
    spec["derived_columns"] = [{"name": n, "type": t, "expression": e} for n, t, e in derived]
    model = Object(m.Transform).read(spec, "")

    def query(spark: SparkSession, d: str) -> DataFrame:
        df, schema = source(spark, d, table)
        if before:
            prepared = {"name": "prepared", "source": table, "grain": [columns[0]]}
            prepared["columns"] = [{"source": c, "target": c} if isinstance(c, str) else {"source": c[0], "target": c[1], "operations": c[2]} for c in before]
            df, schema = models.staging(Object(m.StagingModel).read(prepared, ""), df, schema)
        return models.transform(model, df, schema)[0]

    _register(key, query, sql)


def _join(key: str, left: str, right: str, on: list[tuple[str, str]], kind: str, columns: list[tuple[str, str, str]], sql: str, derived: tuple = (), filters: tuple = (), right_filter: dict | None = None) -> None:
    spec = {"operation": "join", "name": key, "left": left, "right": right, "grain": [columns[0][2]], "filters": list(filters)}
    spec["join"] = {"type": kind, "on": [{"left": a, "right": b} for a, b in on]}
    spec["columns"] = [{"side": s, "source": a, "target": b} for s, a, b in columns]
    spec["derived_columns"] = [{"name": n, "type": t, "expression": e} for n, t, e in derived]
    model = Object(m.JoinModel).read(spec, "")

    def query(spark: SparkSession, d: str) -> DataFrame:
        a, b = source(spark, d, left), source(spark, d, right)
        if right_filter:
            b = (b[0].filter(condition(_condition(right_filter), b[1])), b[1])
        return models.join(model, a, b)[0]

    _register(key, query, sql)


def _condition(spec: dict) -> m.Condition:
    return m.CONDITION.read(spec, "")


def _aggregate(key: str, table: str, by: list[tuple[str, str]], metrics: list[dict], sql: str, filters: tuple = (), output: bool = False, before: list | None = None, rounded: tuple = ()) -> None:
    spec = {"name": key, "source": table, "group_by": [{"source": a, "target": b} for a, b in by], "metrics": metrics, "filters": list(filters), "grain": [by[0][1]]}
    model = Object(m.OutputModel).read(spec, "") if output else Object(m.Aggregate).read(spec | {"operation": "aggregate"}, "")

    def query(spark: SparkSession, d: str) -> DataFrame:
        df, schema = source(spark, d, table)
        if before:
            prepared = {"name": "prepared", "source": table, "grain": [by[0][0]]}
            prepared["columns"] = [{"source": c, "target": c} if isinstance(c, str) else {"source": c[0], "target": c[1], "operations": c[2]} for c in before]
            df, schema = models.staging(Object(m.StagingModel).read(prepared, ""), df, schema)
        out = models.aggregate(model, df, schema)[0]
        return out.select(*[F.round(name(c), 4).alias(c) if c in rounded else name(c) for c in out.columns])

    _register(key, query, sql)


# Staging: column operations.

_staging("stg_trim", "customer", ["c_custkey", ("c_name", "c_name", [{"op": "replace", "old": "#", "new": "  "}, {"op": "replace", "old": "C", "new": "  C"}, {"op": "trim"}])],
         "SELECT c_custkey, trim(replace(replace(c_name, '#', '  '), 'C', '  C')) AS c_name FROM customer")
_staging("stg_lower", "part", ["p_partkey", ("p_type", "kind", [{"op": "lower"}])], "SELECT p_partkey, lower(p_type) AS kind FROM part")
_staging("stg_upper", "part", ["p_partkey", ("p_name", "title", [{"op": "upper"}])], "SELECT p_partkey, upper(p_name) AS title FROM part")
_staging("stg_upper_text", "documents", ["doc_id", ("text", "text", [{"op": "upper"}])], "SELECT doc_id, upper(text) AS text FROM documents")
_staging("stg_replace", "customer", ["c_custkey", ("c_mktsegment", "segment", [{"op": "replace", "old": "U", "new": ""}, {"op": "replace", "old": "I", "new": "ii"}])],
         "SELECT c_custkey, replace(replace(c_mktsegment, 'U', ''), 'I', 'ii') AS segment FROM customer")
_staging("stg_map_keep", "orders", ["o_orderkey", ("o_orderstatus", "status", [{"op": "map_values", "mapping": {"F": "final", "O": "open"}, "on_unmapped": "keep"}])],
         "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
_staging("stg_map_null", "orders", ["o_orderkey", ("o_orderstatus", "status", [{"op": "map_values", "mapping": {"F": "final", "O": "open"}, "on_unmapped": "null"}])],
         "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status FROM orders")
_staging("stg_map_error", "region", ["r_regionkey", ("r_name", "r_name", [{"op": "upper"}, {"op": "map_values", "mapping": {"AFRICA": "AF", "AMERICA": "AM", "ASIA": "AS", "EUROPE": "EU", "MIDDLE EAST": "ME"}, "on_unmapped": "error"}])],
         "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CASE upper(r_name) WHEN 'AFRICA' THEN 'AF' WHEN 'AMERICA' THEN 'AM' WHEN 'ASIA' THEN 'AS' WHEN 'EUROPE' THEN 'EU' WHEN 'MIDDLE EAST' THEN 'ME' END AS r_name FROM region")
_staging("stg_null_if", "part", ["p_partkey", ("p_size", "p_size", [{"op": "null_if", "values": [1, 2, 3]}])],
         "SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3) THEN NULL ELSE CAST(p_size AS BIGINT) END AS p_size FROM part")
_staging("stg_coalesce", "part", ["p_partkey", ("p_size", "p_size", [{"op": "null_if", "values": [1, 2, 3]}, {"op": "coalesce", "value": -1}])],
         "SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3) THEN -1 ELSE CAST(p_size AS BIGINT) END AS p_size FROM part")
_staging("stg_cast_int", "orders", ["o_orderkey", ("o_totalprice", "price", [{"op": "cast", "type": "integer"}])],
         "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS price FROM orders")
_staging("stg_cast_int_text", "orders", ["o_orderkey", ("o_totalprice", "price", [{"op": "cast", "type": "string"}, {"op": "cast", "type": "integer"}])],
         "SELECT o_orderkey, CAST(CAST(o_totalprice AS VARCHAR) AS BIGINT) AS price FROM orders")
_staging("stg_cast_float", "part", ["p_partkey", ("p_size", "size", [{"op": "cast", "type": "float"}])], "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size FROM part")
_staging("stg_cast_string", "lineitem", ["l_orderkey", ("l_extendedprice", "price", [{"op": "cast", "type": "string"}]), ("l_discount", "discount", [{"op": "cast", "type": "string"}])],
         "SELECT l_orderkey, CAST(l_extendedprice AS VARCHAR) AS price, CAST(l_discount AS VARCHAR) AS discount FROM lineitem")
_staging("stg_cast_bool", "lineitem", ["l_orderkey", ("l_linenumber", "some", [{"op": "cast", "type": "boolean"}]), ("l_discount", "cheaper", [{"op": "cast", "type": "boolean"}])],
         "SELECT l_orderkey, CAST(l_linenumber AS BOOLEAN) AS some, CAST(l_discount AS BOOLEAN) AS cheaper FROM lineitem")


def _dated(key: str, operations: list[dict], sql: str) -> None:
    """Casts of order days written as text: a first staging makes the text, a second one reads it."""
    text = "strftime(o_orderdate, '%Y-%m-%d')"

    def query(spark: SparkSession, d: str) -> DataFrame:
        df, _ = source(spark, d, "orders")
        df = df.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
        spec = {"name": key, "source": "orders", "grain": ["o_orderkey"], "columns": [{"source": "o_orderkey", "target": "o_orderkey"}, {"source": "day", "target": "day", "operations": operations}]}
        return models.staging(Object(m.StagingModel).read(spec, ""), df, {"o_orderkey": INTEGER, "day": STRING})[0]

    _register(key, query, sql.format(text=text))


_dated("stg_cast_date", [{"op": "replace", "old": "-", "new": "/"}, {"op": "cast", "type": "date"}], "SELECT o_orderkey, CAST(replace({text}, '-', '/') AS DATE) AS day FROM orders")
_dated("stg_cast_date_text", [{"op": "cast", "type": "date"}, {"op": "cast", "type": "string"}], "SELECT o_orderkey, CAST(CAST({text} AS DATE) AS VARCHAR) AS day FROM orders")
_dated("stg_cast_timestamp", [{"op": "cast", "type": "timestamp"}, {"op": "cast", "type": "string"}], "SELECT o_orderkey, strftime(CAST({text} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') || '+00' AS day FROM orders")
_dated("stg_cast_format", [{"op": "replace", "old": "-", "new": ""}, {"op": "cast", "type": "date", "format": "%Y%m%d"}], "SELECT o_orderkey, CAST(strptime(replace({text}, '-', ''), '%Y%m%d') AS DATE) AS day FROM orders")
_dated("stg_cast_format_loose", [{"op": "replace", "old": "-0", "new": "-"}, {"op": "cast", "type": "date", "format": "%Y-%m-%d"}], "SELECT o_orderkey, CAST(strptime(replace({text}, '-0', '-'), '%Y-%m-%d') AS DATE) AS day FROM orders")
_staging("stg_rename_drop", "supplier", [("s_name", "supplier", []), ("s_suppkey", "id", [])], "SELECT s_name AS supplier, s_suppkey AS id FROM supplier")

# Staging: row operations.

_staging("stg_filter", "events", ["event_id", "event_type", "value"], "SELECT event_id, event_type, value FROM events WHERE value > 50.0 AND event_type <> 'view'",
         rows=({"op": "filter", "condition": {"kind": "all", "conditions": [cmp("gt", col("value"), lit(50.0)), cmp("ne", col("event_type"), lit("view"))]}},))
_FIRST = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}) t WHERE rn = 1"
_dedup = lambda keys, order: {"op": "deduplicate", "keys": keys, "order_by": [{"column": c, "direction": d} for c, d in order]}
_staging("stg_dedup_asc", "events", ["event_id", "user_id", "event_type"], _FIRST.format(cols="event_id, user_id, event_type", keys="user_id, event_type", order="event_id", source="events"),
         rows=(_dedup(["user_id", "event_type"], [("event_id", "asc")]),))
_staging("stg_dedup_desc_nulls_last", "orders", ["o_orderkey", "o_custkey", ("o_totalprice", "price", [{"op": "cast", "type": "integer"}]), ("o_orderpriority", "priority", [{"op": "null_if", "values": ["1-URGENT", "5-LOW"]}])],
         _FIRST.format(cols="o_orderkey, o_custkey, price, priority", keys="o_custkey", order="priority DESC NULLS LAST, o_orderkey", source="(SELECT o_orderkey, o_custkey, CAST(o_totalprice AS BIGINT) AS price, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN NULL ELSE o_orderpriority END AS priority FROM orders)"),
         rows=(_dedup(["o_custkey"], [("priority", "desc"), ("o_orderkey", "asc")]),))
_OPEN = {"op": "filter", "condition": cmp("eq", col("o_orderstatus"), lit("O"))}
_staging("stg_filter_then_dedup", "orders", ["o_orderkey", "o_custkey", "o_orderstatus"], _FIRST.format(cols="o_orderkey, o_custkey, o_orderstatus", keys="o_custkey", order="o_orderkey", source="(SELECT * FROM orders WHERE o_orderstatus = 'O')"),
         rows=(_OPEN, _dedup(["o_custkey"], [("o_orderkey", "asc")])))
_staging("stg_dedup_then_filter", "orders", ["o_orderkey", "o_custkey", "o_orderstatus"], _FIRST.format(cols="o_orderkey, o_custkey, o_orderstatus", keys="o_custkey", order="o_orderkey", source="orders") + " AND o_orderstatus = 'O'",
         rows=(_dedup(["o_custkey"], [("o_orderkey", "asc")]), _OPEN))

# Expressions.

for _op, _sign in (("add", "+"), ("subtract", "-"), ("multiply", "*")):
    _transform(f"expr_{_op}", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], [("whole", "integer", binary(_op, col("l_orderkey"), col("l_linenumber"))), ("mixed", "float", binary(_op, col("l_quantity"), col("l_linenumber")))], [],
               f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_orderkey {_sign} CAST(l_linenumber AS BIGINT) AS whole, l_quantity {_sign} CAST(l_linenumber AS DOUBLE) AS mixed FROM lineitem")
_transform("expr_divide_safe", "lineitem", ["l_orderkey", "l_tax", "l_discount", "l_linenumber"], [("ratio", "float", binary("divide", col("l_tax"), col("l_discount"))), ("half", "float", binary("divide", col("l_linenumber"), lit(2)))], [],
           "SELECT l_orderkey, l_tax, l_discount, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_discount IS NULL OR l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio, CAST(l_linenumber AS DOUBLE) / 2.0 AS half FROM lineitem")
for _part, _sql in (("year", "year"), ("quarter", "quarter"), ("month", "month"), ("day", "day"), ("day_of_week", "isodow")):
    _transform(f"expr_{_part}", "orders", ["o_orderkey", "o_orderdate"], [("part", "integer", part(_part, "o_orderdate"))], [], f"SELECT o_orderkey, o_orderdate, extract({_sql} FROM o_orderdate) AS part FROM orders")
_NULLED = ["p_partkey", ("p_size", "p_size", [{"op": "null_if", "values": [1, 2, 3, 4, 5]}]), "p_retailprice", "p_brand"]
_NULLED_SQL = "(SELECT p_partkey, CASE WHEN p_size <= 5 THEN NULL ELSE CAST(p_size AS BIGINT) END AS p_size, p_retailprice, p_brand FROM part)"
def _projected(key: str, columns: list[str], derived: list, filters: list, sql: str) -> None:
    _transform(key, "part", columns, derived, filters, sql, before=_NULLED)


_projected("expr_coalesce", ["p_partkey", "p_size", "p_retailprice"], [("size", "float", {"kind": "coalesce", "values": [col("p_size"), col("p_retailprice")]}), ("whole", "integer", {"kind": "coalesce", "values": [col("p_size"), lit(0)]})], [],
           f"SELECT p_partkey, p_size, p_retailprice, coalesce(CAST(p_size AS DOUBLE), p_retailprice) AS size, coalesce(p_size, 0) AS whole FROM {_NULLED_SQL} t")
_transform("expr_nested", "lineitem", ["l_orderkey", "l_extendedprice", "l_discount", "l_tax"], [("charge", "float", binary("multiply", binary("multiply", col("l_extendedprice"), binary("subtract", lit(1), col("l_discount"))), binary("add", lit(1.0), col("l_tax"))))], [],
           "SELECT l_orderkey, l_extendedprice, l_discount, l_tax, l_extendedprice * (CAST(1 AS DOUBLE) - l_discount) * (CAST(1.0 AS DOUBLE) + l_tax) AS charge FROM lineitem")

# Conditions.

for _op, _sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    _projected(f"cond_{_op}", ["p_partkey", "p_size"], [], [cmp(_op, col("p_size"), lit(25))], f"SELECT p_partkey, p_size FROM {_NULLED_SQL} t WHERE p_size {_sign} 25")
_projected("cond_in", ["p_partkey", "p_size"], [], [isin(col("p_size"), [7, 9, 11])], f"SELECT p_partkey, p_size FROM {_NULLED_SQL} t WHERE p_size IN (7, 9, 11)")
_projected("cond_not_in_null", ["p_partkey", "p_size"], [], [isin(col("p_size"), [7, 9, 11], True)], f"SELECT p_partkey, p_size FROM {_NULLED_SQL} t WHERE p_size NOT IN (7, 9, 11)")
_projected("cond_is_null", ["p_partkey", "p_size"], [], [null(col("p_size"))], f"SELECT p_partkey, p_size FROM {_NULLED_SQL} t WHERE p_size IS NULL")
_projected("cond_is_not_null", ["p_partkey", "p_size"], [], [null(col("p_size"), True)], f"SELECT p_partkey, p_size FROM {_NULLED_SQL} t WHERE p_size IS NOT NULL")
_projected("cond_all", ["p_partkey", "p_size", "p_retailprice"], [], [{"kind": "all", "conditions": [cmp("gt", col("p_size"), lit(10)), cmp("lt", col("p_retailprice"), lit(1500.0))]}],
           f"SELECT p_partkey, p_size, p_retailprice FROM {_NULLED_SQL} t WHERE p_size > 10 AND p_retailprice < 1500.0")
_projected("cond_any", ["p_partkey", "p_size", "p_retailprice"], [], [{"kind": "any", "conditions": [cmp("gt", col("p_size"), lit(40)), cmp("lt", col("p_retailprice"), lit(1000.0))]}],
           f"SELECT p_partkey, p_size, p_retailprice FROM {_NULLED_SQL} t WHERE p_size > 40 OR p_retailprice < 1000.0")
_projected("cond_not", ["p_partkey", "p_size"], [], [{"kind": "not", "condition": cmp("gt", col("p_size"), lit(20))}],
           f"SELECT p_partkey, p_size FROM {_NULLED_SQL} t WHERE NOT (p_size > 20)")

# Intermediate and output models.

_transform("int_transform", "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"], [("year", "integer", part("year", "o_orderdate")), ("vat", "float", binary("multiply", col("o_totalprice"), lit(0.19)))], [cmp("gte", col("year"), lit(1997))],
           "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, year(o_orderdate) AS year, o_totalprice * CAST(0.19 AS DOUBLE) AS vat FROM orders WHERE year(o_orderdate) >= 1997")
_CO = [("left", "o_orderkey", "o_orderkey"), ("right", "c_name", "customer"), ("right", "c_mktsegment", "segment"), ("left", "o_totalprice", "price")]
_join("int_join_inner", "orders", "customer", [("o_custkey", "c_custkey")], "inner", _CO, "SELECT o_orderkey, c_name AS customer, c_mktsegment AS segment, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey")
_join("int_join_left", "orders", "customer", [("o_custkey", "c_custkey")], "left", _CO, "SELECT o_orderkey, c_name AS customer, c_mktsegment AS segment, o_totalprice AS price FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000.0) c ON o_custkey = c_custkey",
      right_filter=cmp("gt", col("c_acctbal"), lit(5000.0)))
_join("int_join_composite", "lineitem", "lineitem", [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber"), ("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey")], "inner", [("left", "l_orderkey", "order_key"), ("left", "l_partkey", "part_key"), ("right", "l_quantity", "quantity")],
      "SELECT a.l_orderkey AS order_key, a.l_partkey AS part_key, b.l_quantity AS quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
_join("int_join_derived_filter", "lineitem", "part", [("l_partkey", "p_partkey")], "inner", [("left", "l_orderkey", "l_orderkey"), ("left", "l_quantity", "quantity"), ("right", "p_retailprice", "price")],
      "SELECT l_orderkey, l_quantity AS quantity, p_retailprice AS price, l_quantity * p_retailprice AS total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity * p_retailprice > 40000.0",
      derived=(("total", "float", binary("multiply", col("quantity"), col("price"))),), filters=(cmp("gt", col("total"), lit(40000.0)),))


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts, many to many, through lineitem: two ordinary joins."""
    first = Object(m.JoinModel).read({"operation": "join", "name": "a", "left": "lineitem", "right": "supplier", "join": {"type": "inner", "on": [{"left": "l_suppkey", "right": "s_suppkey"}]}, "grain": ["l_orderkey"],
             "columns": [{"side": "left", "source": "l_orderkey", "target": "l_orderkey"}, {"side": "left", "source": "l_partkey", "target": "l_partkey"}, {"side": "right", "source": "s_name", "target": "supplier"}]}, "")
    second = Object(m.JoinModel).read({"operation": "join", "name": "b", "left": "a", "right": "part", "join": {"type": "inner", "on": [{"left": "l_partkey", "right": "p_partkey"}]}, "grain": ["l_orderkey"],
              "columns": [{"side": "left", "source": "l_orderkey", "target": "l_orderkey"}, {"side": "left", "source": "supplier", "target": "supplier"}, {"side": "right", "source": "p_name", "target": "part"}]}, "")
    return models.join(second, models.join(first, source(spark, d, "lineitem"), source(spark, d, "supplier")), source(spark, d, "part"))[0]


_register("int_join_bridge", _bridge, "SELECT l_orderkey, s_name AS supplier, p_name AS part FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey")
_N = {"name": "n", "function": "count_rows"}
_aggregate("int_aggregate", "orders", [("o_custkey", "customer"), ("o_orderstatus", "status")], [_N, {"name": "last", "function": "max", "column": "o_orderkey"}], "SELECT o_custkey AS customer, o_orderstatus AS status, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1, 2")
_aggregate("int_aggregate_filter", "lineitem", [("l_returnflag", "flag")], [_N, {"name": "least", "function": "min", "column": "l_quantity"}], "SELECT l_returnflag AS flag, count(*) AS n, min(l_quantity) AS least FROM lineitem WHERE l_discount > 0.05 AND l_tax < 0.04 GROUP BY 1",
           filters=(cmp("gt", col("l_discount"), lit(0.05)), cmp("lt", col("l_tax"), lit(0.04))))


def _dedup_model(spark: SparkSession, d: str) -> DataFrame:
    spec = {"operation": "deduplicate", "name": "x", "source": "orders", "keys": ["o_custkey"], "grain": ["o_custkey"], "order_by": [{"column": "o_totalprice", "direction": "desc"}, {"column": "o_orderkey"}]}
    df, schema = source(spark, d, "orders")
    return models.deduplicate(Object(m.Deduplicate).read(spec, ""), df, schema)[0]


_register("int_dedup", _dedup_model, _FIRST.format(cols="o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority", keys="o_custkey", order="o_totalprice DESC NULLS LAST, o_orderkey", source="orders"))
_aggregate("out_aggregate", "events", [("event_type", "type")], [_N, {"name": "users", "function": "count_distinct", "column": "user_id"}], "SELECT event_type AS type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1", output=True)
_aggregate("out_filtered", "events", [("event_type", "type"), ("user_id", "user_id")], [_N], "SELECT event_type AS type, user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2", filters=(isin(col("event_type"), ["click", "purchase"]),), output=True)

# Metrics, over a table with nulls.

_BEFORE = ["p_partkey", "p_brand", ("p_size", "p_size", [{"op": "null_if", "values": [1, 2, 3, 4, 5]}]), "p_retailprice"]
for _key, _metric, _sql in (
    ("m_count_rows", _N, "count(*)"),
    ("m_count", {"name": "n", "function": "count", "column": "p_size"}, "count(p_size)"),
    ("m_count_distinct", {"name": "n", "function": "count_distinct", "column": "p_size"}, "count(DISTINCT p_size)"),
    ("m_sum_int", {"name": "n", "function": "sum", "column": "p_size"}, "CAST(sum(p_size) AS DOUBLE)"),
    ("m_sum_float", {"name": "n", "function": "sum", "column": "p_retailprice"}, "round(sum(p_retailprice), 4)"),
    ("m_avg", {"name": "n", "function": "avg", "column": "p_size"}, "round(avg(p_size), 4)"),
    ("m_avg_float", {"name": "n", "function": "avg", "column": "p_retailprice"}, "round(avg(p_retailprice), 4)"),
    ("m_min", {"name": "n", "function": "min", "column": "p_size"}, "min(p_size)"),
    ("m_max", {"name": "n", "function": "max", "column": "p_retailprice"}, "max(p_retailprice)"),
    ("m_cond_count", {"name": "n", "function": "conditional_count", "condition": cmp("gt", col("p_size"), lit(45))}, "count(*) FILTER (WHERE p_size > 45)"),
    ("m_cond_sum", {"name": "n", "function": "conditional_sum", "column": "p_size", "condition": cmp("gt", col("p_retailprice"), lit(1800.0))}, "CAST(sum(p_size) FILTER (WHERE p_retailprice > 1800.0) AS DOUBLE)"),
    ("m_cond_sum_none", {"name": "n", "function": "conditional_sum", "column": "p_size", "condition": cmp("lt", col("p_retailprice"), lit(0.0))}, "CAST(sum(p_size) FILTER (WHERE p_retailprice < 0.0) AS DOUBLE)"),
):
    _aggregate(_key, "part", [("p_brand", "brand")], [_metric], f"SELECT p_brand AS brand, {_sql} AS n FROM {_NULLED_SQL} t GROUP BY 1", before=_BEFORE, rounded=("n",) if "round" in _sql else ())

# Assertions: violating rows.


def _check(key: str, table: str, spec: dict, sql: str, to: str | None = None, where: str | None = None) -> None:
    kind = {"not_null": m.NotNull, "unique": m.Unique, "relationships": m.References, "accepted_values": m.AcceptedValues, "row_count": m.RowsBetween, "column_range": m.ColumnRange}[spec["type"]]
    assertion = Object(kind).read(spec | {"name": key, "model": table} | ({"to_model": to} if to else {}), "")

    def query(spark: SparkSession, d: str) -> DataFrame:
        tables = {t: source(spark, d, t)[0] for t in {table, to} - {None}}
        if table == "part":
            tables["part"] = tables["part"].withColumn("p_size", F.when(F.col("p_size") > 5, F.col("p_size")))
        if where:
            tables[to] = tables[to].filter(where)
        return checks.violations(assertion, tables)[0][1]

    _register(key, query, sql)


_PART = "(SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_size <= 5 THEN NULL ELSE CAST(p_size AS BIGINT) END AS p_size, p_retailprice FROM part) t"
_check("chk_not_null", "part", {"type": "not_null", "columns": ["p_size"]}, f"SELECT * FROM {_PART} WHERE p_size IS NULL")
_check("chk_unique", "lineitem", {"type": "unique", "columns": ["l_orderkey"]}, "SELECT l_orderkey, count(*) AS n_records FROM lineitem GROUP BY 1 HAVING count(*) > 1")
_check("chk_unique_composite", "part", {"type": "unique", "columns": ["p_brand", "p_size"]}, f"SELECT p_brand, p_size, count(*) AS n_records FROM {_PART} WHERE p_size IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
_check("chk_relationships", "orders", {"type": "relationships", "columns": ["o_custkey"], "to_columns": ["c_custkey"]}, "SELECT o_custkey AS key_1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", "customer", "c_acctbal > 0")
_check("chk_relationships_composite", "part", {"type": "relationships", "columns": ["p_brand", "p_size"], "to_columns": ["p_brand", "p_size"]}, f"SELECT p_brand AS key_1, p_size AS key_2 FROM {_PART} WHERE p_size IS NULL", "part")
_check("chk_accepted_values", "orders", {"type": "accepted_values", "column": "o_orderstatus", "values": ["F", "O"]}, "SELECT * FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
_check("chk_row_count", "nation", {"type": "row_count", "min": 26}, "SELECT * FROM (SELECT count(*) AS n_rows FROM nation) t WHERE n_rows < 26")
_check("chk_row_count_ok", "nation", {"type": "row_count", "min": 1, "max": 25}, "SELECT * FROM (SELECT count(*) AS n_rows FROM nation) t WHERE n_rows < 1 OR n_rows > 25")
_check("chk_column_range_incl", "part", {"type": "column_range", "column": "p_size", "min": 10, "max": 40}, f"SELECT * FROM {_PART} WHERE p_size < 10 OR p_size > 40")
_check("chk_column_range_excl", "part", {"type": "column_range", "column": "p_size", "min": 10, "max": 40, "inclusive": False}, f"SELECT * FROM {_PART} WHERE p_size <= 10 OR p_size >= 40")

# Topologies: whole pipelines of several models.


def _model(kind: type, **spec: Any) -> Any:
    return Object(kind).read(spec, "")


def revenue_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: staging, two joins with a derived column, and an output aggregation."""
    upper = [{"op": "trim"}, {"op": "upper"}]
    customers = _model(m.StagingModel, name="stg_customer", source="customer", grain=["c_custkey"], columns=[{"source": "c_custkey", "target": "c_custkey"}, {"source": "c_mktsegment", "target": "segment", "operations": upper}])
    orders = _model(m.StagingModel, name="stg_orders", source="orders", grain=["o_orderkey"], columns=_same(["o_orderkey", "o_custkey", "o_orderstatus"]), row_operations=[{"op": "filter", "condition": isin(col("o_orderstatus"), ["F", "O"])}])
    lines = _model(m.StagingModel, name="stg_lineitem", source="lineitem", grain=["l_orderkey"], columns=_same(["l_orderkey", "l_extendedprice", "l_discount"]))
    a = _model(m.JoinModel, operation="join", name="j_orders", left="stg_orders", right="stg_customer", grain=["o_orderkey"], join={"type": "inner", "on": [{"left": "o_custkey", "right": "c_custkey"}]}, columns=[{"side": "left", "source": "o_orderkey", "target": "o_orderkey"}, {"side": "right", "source": "segment", "target": "segment"}])
    b = _model(m.JoinModel, operation="join", name="j_full", left="stg_lineitem", right="j_orders", grain=["l_orderkey"], join={"type": "inner", "on": [{"left": "l_orderkey", "right": "o_orderkey"}]},
               columns=[{"side": "left", "source": c, "target": c} for c in ("l_orderkey", "l_extendedprice", "l_discount")] + [{"side": "right", "source": "segment", "target": "segment"}],
               derived_columns=[{"name": "revenue", "type": "float", "expression": binary("multiply", col("l_extendedprice"), binary("subtract", lit(1.0), col("l_discount")))}])
    out = _model(m.OutputModel, name="o_revenue", source="j_full", grain=["segment"], group_by=_same(["segment"]), metrics=[{"name": "n_lines", "function": "count_rows"}, {"name": "revenue", "function": "sum", "column": "revenue"}])
    built = {t: source(spark, sf_dir, t) for t in ("customer", "orders", "lineitem")}
    for model in (customers, orders, lines, a, b, out):
        built[model.name] = models.build(model, built)
    return built["o_revenue"][0].withColumn("revenue", F.round("revenue", 4))


_register("topo_late_join", revenue_by_segment, "SELECT upper(trim(c_mktsegment)) AS segment, count(*) AS n_lines, round(sum(l_extendedprice * (CAST(1 AS DOUBLE) - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")


def _agg_before_join(spark: SparkSession, d: str) -> DataFrame:
    per_order = _model(m.Aggregate, operation="aggregate", name="per_order", source="lineitem", group_by=[{"source": "l_orderkey", "target": "order_key"}], grain=["order_key"], metrics=[{"name": "lines", "function": "count_rows"}, {"name": "most", "function": "max", "column": "l_quantity"}])
    joined = _model(m.JoinModel, operation="join", name="j", left="orders", right="per_order", grain=["o_orderkey"], join={"type": "left", "on": [{"left": "o_orderkey", "right": "order_key"}]}, columns=[{"side": "left", "source": "o_orderkey", "target": "o_orderkey"}, {"side": "left", "source": "o_orderstatus", "target": "status"}, {"side": "right", "source": "lines", "target": "lines"}, {"side": "right", "source": "most", "target": "most"}])
    built = {t: source(spark, d, t) for t in ("orders", "lineitem")}
    for model in (per_order, joined):
        built[model.name] = models.build(model, built)
    return built["j"][0]


_register("topo_agg_before_join", _agg_before_join, "SELECT o_orderkey, o_orderstatus AS status, lines, most FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS lines, max(l_quantity) AS most FROM lineitem GROUP BY 1) t ON o_orderkey = l_orderkey")


def _agg_after_join(spark: SparkSession, d: str) -> DataFrame:
    nations = _model(m.JoinModel, operation="join", name="j", left="customer", right="nation", grain=["c_custkey"], join={"type": "inner", "on": [{"left": "c_nationkey", "right": "n_nationkey"}]}, columns=[{"side": "left", "source": "c_custkey", "target": "c_custkey"}, {"side": "left", "source": "c_acctbal", "target": "balance"}, {"side": "right", "source": "n_name", "target": "nation"}, {"side": "right", "source": "n_regionkey", "target": "region"}])
    out = _model(m.OutputModel, name="o", source="j", grain=["nation"], group_by=_same(["nation", "region"]), dimensions=["region"], metrics=[_N, {"name": "in_debt", "function": "conditional_count", "condition": cmp("lt", col("balance"), lit(0))}])
    built = {t: source(spark, d, t) for t in ("customer", "nation")}
    for model in (nations, out):
        built[model.name] = models.build(model, built)
    return built["o"][0]


_register("topo_agg_after_join", _agg_after_join, "SELECT n_name AS nation, CAST(n_regionkey AS BIGINT) AS region, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS in_debt FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")


def _two_outputs(spark: SparkSession, d: str) -> DataFrame:
    """One branch read by two outputs, put side by side for the check."""
    daily = _model(m.Transform, operation="transform", name="t", source="events", grain=["event_id"], columns=_same(["event_id", "ts", "event_type"]), derived_columns=[{"name": "month", "type": "integer", "expression": part("month", "ts")}])
    by_type = _model(m.OutputModel, name="a", source="t", grain=["event_type"], group_by=_same(["event_type"]), metrics=[_N])
    by_month = _model(m.OutputModel, name="b", source="t", grain=["month"], group_by=_same(["month"]), metrics=[_N])
    built = {"events": source(spark, d, "events")}
    for model in (daily, by_type, by_month):
        built[model.name] = models.build(model, built)
    first = built["a"][0].select(F.lit("type").alias("output"), F.col("event_type").alias("key"), "n")
    return first.unionAll(built["b"][0].select(F.lit("month"), F.col("month").cast("string"), "n"))


_register("topo_branch_two_outputs", _two_outputs, "SELECT 'type' AS output, event_type AS key, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'month', CAST(month(ts) AS VARCHAR), count(*) FROM events GROUP BY 2")
_join("topo_early_join", "supplier", "nation", [("s_nationkey", "n_nationkey")], "inner", [("left", "s_suppkey", "s_suppkey"), ("left", "s_acctbal", "balance"), ("right", "n_name", "nation")], "SELECT s_suppkey, s_acctbal AS balance, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")

# Previews.

_register("preview_topk", lambda spark, d: top(source(spark, d, "orders")[0].select("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderkey",)), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey NULLS LAST LIMIT 5")

# Sources: a verified scan, a row count, and generators, whose random kinds are held against what they must keep.

_DOCUMENTS: Schema = {"doc_id": INTEGER, "text": STRING, "lang": STRING, "source": STRING, "n_chars": INTEGER}
_register("io_parquet_scan", lambda spark, d: parquet.read(spark, f"{d}/documents.parquet", _DOCUMENTS), "SELECT doc_id, text, lang, source, n_chars FROM documents")
_register("io_row_count", lambda spark, d: source(spark, d, "lineitem")[0].agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem")
_register("io_checksum", lambda spark, d: spark.createDataFrame([(*checksum(source(spark, d, "orders")[0]), *checksum(source(spark, d, "orders")[0].repartition(5)))], "n bigint, a string, m bigint, b string").selectExpr("n", "n = m and a = b as same"), "SELECT count(*) AS n, true AS same FROM orders")


def _share(condition: Any, p: float, n: int) -> Any:
    """Whether the share of rows with the condition lies within five standard errors of p; exactly, if p is 0 or 1."""
    return F.abs(F.avg(F.coalesce(condition, F.lit(False)).cast("double")) - p) <= 5 * (p * (1 - p) / n) ** 0.5


def _generated(key: str, spec: dict, n: int, inside: Callable, sql: str | None = None, once: bool = False, shares: Callable | None = None) -> None:
    """n draws of a generator: themselves if SQL can tell them, else whether all are inside, differ and have the shares they should."""
    g = m.GENERATOR.read(spec, "")

    def query(spark: SparkSession, d: str) -> DataFrame:
        make = (lambda i: values.distinct(g, i, n, 11)) if once else (lambda i: values.drawn(g, i, 11))
        rows = spark.range(n).select(F.col("id").alias("row"), make(F.col("id")).alias("value"))
        if sql:
            return rows
        different = F.count_distinct("value") == n if once else F.count_distinct("value") > 1
        fair = [_share(found, p, n) for found, p in shares(F.col("value"))] if shares else [F.lit(True)]
        return rows.agg(F.count("value").alias("n"), F.every(inside(F.col("value"))).alias("inside"), different.alias("different"), reduce(lambda a, b: a & b, fair).alias("fair"))

    _register(key, query, sql or f"SELECT CAST({n} AS BIGINT) AS n, true AS inside, true AS different, true AS fair")


_generated("gen_formatted_id", {"kind": "formatted_id", "prefix": "ID-", "digits": 5, "start": 7}, 500, None, "SELECT i AS row, 'ID-' || lpad(CAST(i + 7 AS VARCHAR), 5, '0') AS value FROM range(500) t(i)")
_generated("gen_integer_range", {"kind": "integer_range", "min": -5, "max": 5}, 20000, lambda x: x.between(-5, 5), shares=lambda x: [(x == k, 1 / 11) for k in range(-5, 6)])
_generated("gen_float_range", {"kind": "float_range", "min": 0.5, "max": 9.5, "decimal_places": 1}, 20000, lambda x: x.between(0.5, 9.5) & (F.round(x, 1) == x), shares=lambda x: [(x == 0.5, 1 / 91), (x < 4.95, 45 / 91), (x == 9.5, 1 / 91)])
_generated("gen_date_range", {"kind": "date_range", "min": "2024-02-01", "max": "2024-03-01"}, 20000, lambda x: x.between("2024-02-01", "2024-03-01"), shares=lambda x: [(x == "2024-02-29", 1 / 30), (x < "2024-02-16", 15 / 30), (x == "2024-03-01", 1 / 30)])
_generated("gen_timestamp_range", {"kind": "timestamp_range", "min": "2024-02-01T00:00:00+00:00", "max": "2024-02-02T00:00:00+00:00"}, 20000, lambda x: F.unix_seconds(x).between(1706745600, 1706832000), shares=lambda x: [(F.hour(x) == k, 1 / 24) for k in range(24)])
_generated("gen_categorical", {"kind": "categorical", "values": ["a", "b", "c"], "weights": [1.0, 2.0, 0.0]}, 20000, lambda x: x.isin("a", "b"), shares=lambda x: [(x == "a", 1 / 3), (x == "b", 2 / 3), (x == "c", 0.0)])
_generated("gen_boolean", {"kind": "boolean", "true_probability": 0.25}, 20000, lambda x: x.isNotNull(), shares=lambda x: [(x, 0.25), (~x, 0.75)])
_generated("gen_random_string", {"kind": "random_string", "min_length": 3, "max_length": 6}, 20000, lambda x: x.rlike("^[a-z0-9]{3,6}$"), shares=lambda x: [(F.length(x) == k, 1 / 4) for k in range(3, 7)] + [(x.rlike("^[0-9]"), 10 / 36), (x.rlike("z$"), 1 / 36)])
_generated("gen_unique_integer", {"kind": "integer_range", "min": 1, "max": 1000}, 1000, lambda x: x.between(1, 1000), once=True)
_generated("gen_unique_string", {"kind": "random_string", "min_length": 2, "max_length": 3, "alphabet": "abcdefghij"}, 1000, lambda x: x.rlike("^[a-j]{2,3}$"), once=True)
for _kind, _pattern in (("person_name", r"^\S+ \S+$"), ("email", r"^[a-zü.äöß]+[0-9]+@[a-z.]+$"), ("city", r"^\S+$"), ("street_address", r"^\S+ [0-9]+, [0-9]{5} \S+$"), ("company_name", r"^\S+ .+$"), ("phone_number", r"^\+49 [0-9]+ [0-9]+$")):
    _generated(f"gen_{_kind}", {"kind": _kind}, 500, lambda x, p=_pattern: x.rlike(p))


def _template(spark: SparkSession, d: str) -> DataFrame:
    g = m.GENERATOR.read({"kind": "template_string", "template": "{o_orderkey}/{o_orderstatus}:{o_totalprice}"}, "")
    df, schema = source(spark, d, "orders")
    return df.select("o_orderkey", values.templated(g, schema).alias("label"))


_register("gen_template_string", _template, "SELECT o_orderkey, o_orderkey || '/' || o_orderstatus || ':' || CAST(o_totalprice AS VARCHAR) AS label FROM orders")


def scenario_outputs(scenario: str) -> Query:
    """How many checks of a bundled scenario's synthetic raw tables hold, and how many rows each table has."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        plan = resolve(document.parse(load(scenario)))
        tables, counts = synthesise(spark, plan, 0)
        mine = [a for a in plan.assertions() if a.model in tables and getattr(a, "to_model", a.model) in tables]
        found = [rows.agg(F.lit(key).alias("check"), F.count(F.lit(1)).alias("violations")) for a in mine for key, rows in checks.violations(a, tables)]
        return reduce(DataFrame.unionAll, found).filter("violations > 0").unionAll(spark.createDataFrame([("checks", len(found)), ("tables", len(counts))], "check string, violations bigint"))

    return query


_register("gen_foreign_keys", scenario_outputs("library_loans_001"), "SELECT * FROM (VALUES ('checks', CAST(17 AS BIGINT)), ('tables', CAST(3 AS BIGINT))) t(\"check\", violations)")
_register("gen_bridge_and_composite_key", scenario_outputs("tours_guides_001"), "SELECT * FROM (VALUES ('checks', CAST(15 AS BIGINT)), ('tables', CAST(3 AS BIGINT))) t(\"check\", violations)")

# Raw tables as wholes: null rates, keys and row counts that generation must keep.


def _scenario(name: str, **rows: int) -> dict:
    """A bundled scenario whose raw tables named in rows have exactly so many."""
    spec = json.loads(load(name))
    for table in spec["raw_tables"]:
        if n := rows.get(table["name"]):
            table["rows"] = {"min": n, "max": n}
    return spec


def _raw_tables(spark: SparkSession, spec: dict) -> dict[str, DataFrame]:
    return synthesise(spark, resolve(document.parse(json.dumps(spec))), 0)[0]


def _null_masks(spark: SparkSession, d: str) -> DataFrame:
    """Nulls of a column and of a key of two parts, which are null together; other columns have none."""
    n = 20_000
    parcels = _raw_tables(spark, _scenario("parcels_depots_001", raw_parcels=n))["raw_parcels"]
    lane, depot, grams = (F.col(c).isNull() for c in ("lane", "depot_id", "grams"))
    return parcels.agg(
        F.count(F.lit(1)).alias("n"), F.every(lane == depot).alias("together"), _share(lane, 0.2, n).alias("key_share"), _share(grams, 0.1, n).alias("share"),
        _share(lane & grams, 0.02, n).alias("independent"), F.count_if(F.col("parcel_id").isNull() | F.col("sent_on").isNull()).alias("others"),
    )


def _keys_once(spark: SparkSession, d: str) -> DataFrame:
    """A one-to-one key: each parent at most once, those that are left out from everywhere, in no order."""
    tables = _raw_tables(spark, _scenario("parcels_depots_001", raw_parcels=4_000, raw_receipts=2_000))
    receipts, parcels = tables["raw_receipts"], tables["raw_parcels"].select("parcel_id", F.lit(True).alias("known"))
    found = receipts.join(parcels, "parcel_id", "left")
    lower = F.col("parcel_id") <= 500_000
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("parcel_id").alias("parents"), F.count("known").alias("known"), _share(lower, 0.5, 2_000).alias("fair"), (F.abs(F.corr(F.substring("receipt_id", 3, 6).cast("int"), F.col("parcel_id"))) < 0.1).alias("unordered"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of fifty seeds: within their bounds, with room for all keys, not always the same."""
    plan = resolve(document.parse(load("parcels_depots_001")))
    found = [(seed, *(row_counts(plan, seed)[t] for t in ("raw_depots", "raw_lanes", "raw_parcels", "raw_receipts"))) for seed in range(50)]
    df = spark.createDataFrame(found, "seed bigint, depots bigint, lanes bigint, parcels bigint, receipts bigint")
    inside = F.col("depots").between(4, 9) & F.col("lanes").between(20, 30) & F.col("parcels").between(200, 500) & F.col("receipts").between(150, 600)
    room = (F.col("lanes") <= 6 * F.col("depots")) & (F.col("receipts") <= F.col("parcels"))
    return df.agg(F.count("seed").alias("n"), F.every(inside).alias("inside"), F.every(room).alias("room"), (F.count_distinct("parcels") > 30).alias("different"))


def _vast_key(spark: SparkSession, d: str) -> DataFrame:
    """A key of a long string and two foreign keys: its tuples differ, and no part is cut."""
    spec = _scenario("tours_guides_001", raw_assignments=3_000)
    table, staged = spec["raw_tables"][2], spec["staging_models"][2]
    table["columns"].insert(0, {"name": "note", "type": "string", "generator": {"kind": "random_string", "min_length": 12, "max_length": 12}})
    table["primary_key"].append("note")
    staged["columns"] += _same(["note"])
    staged["row_operations"][0]["order_by"].append({"column": "note"})
    tables = _raw_tables(spark, spec)
    guides, tours = tables["raw_guides"].count(), tables["raw_tours"].count()
    return tables["raw_assignments"].agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("note", "guide_id", "tour_id").alias("keys"), (F.count_distinct("guide_id") == guides).alias("all_guides"),
        (F.count_distinct("tour_id") == tours).alias("all_tours"), F.count_distinct(F.substring("note", 1, 1)).alias("letters"),
    )


def _derived(spark: SparkSession, d: str) -> DataFrame:
    """The assertions that follow from a scenario's declarations, by kind, table and columns."""
    plan = resolve(document.parse(load("parcels_depots_001")))
    rows = [(a.type, a.model, ",".join(getattr(a, "columns", ()))) for a in plan.derived]
    return spark.createDataFrame(rows, "kind string, model string, columns string")


_DERIVED_SQL = """
WITH keys(model, columns) AS (VALUES ('raw_depots', ['depot_id']), ('raw_lanes', ['depot_id', 'lane']), ('raw_parcels', ['parcel_id']), ('raw_receipts', ['receipt_id']), ('stg_depots', ['depot_id']),
  ('stg_lanes', ['depot_id', 'lane']), ('stg_parcels', ['parcel_id']), ('stg_receipts', ['receipt_id']), ('j_lanes', ['depot_id', 'lane']), ('j_parcels', ['parcel_id']), ('j_receipts', ['receipt_id']), ('o_signed_by_area', ['area', 'month']))
SELECT 'unique' AS kind, model, array_to_string(columns, ',') AS columns FROM keys
UNION ALL SELECT 'not_null', model, unnest(columns) FROM keys
UNION ALL SELECT 'unique', 'raw_receipts', 'parcel_id'
UNION ALL SELECT 'not_null', * FROM (VALUES ('raw_depots', 'region'), ('raw_lanes', 'metres'), ('raw_parcels', 'sent_on'), ('raw_receipts', 'parcel_id'), ('raw_receipts', 'signed')) t
UNION ALL SELECT 'relationships', * FROM (VALUES ('raw_lanes', 'depot_id'), ('raw_parcels', 'depot_id,lane'), ('raw_receipts', 'parcel_id')) t
UNION ALL SELECT 'row_count', 'o_signed_by_area', ''
"""
_register("gen_null_masks", _null_masks, "SELECT CAST(20000 AS BIGINT) AS n, true AS together, true AS key_share, true AS share, true AS independent, CAST(0 AS BIGINT) AS others")
_register("gen_keys_once", _keys_once, "SELECT CAST(2000 AS BIGINT) AS n, CAST(2000 AS BIGINT) AS parents, CAST(2000 AS BIGINT) AS known, true AS fair, true AS unordered")
_register("gen_row_counts", _counts, "SELECT CAST(50 AS BIGINT) AS n, true AS inside, true AS room, true AS different")
_register("gen_vast_key", _vast_key, "SELECT CAST(3000 AS BIGINT) AS n, CAST(3000 AS BIGINT) AS keys, true AS all_guides, true AS all_tours, CAST(36 AS BIGINT) AS letters")
_register("chk_derived", _derived, _DERIVED_SQL)
_register("gen_composite_foreign_key", scenario_outputs("parcels_depots_001"), "SELECT * FROM (VALUES ('checks', CAST(18 AS BIGINT)), ('tables', CAST(4 AS BIGINT))) t(\"check\", violations)")


def _sink(spark: SparkSession, d: str) -> DataFrame:
    """A whole table, written with its declared columns in their order and read back."""
    schema: Schema = {"order_status": STRING, "o_orderkey": INTEGER, "o_totalprice": FLOAT, "o_orderpriority": STRING}
    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    parquet.write(source(spark, d, "orders")[0].withColumnRenamed("o_orderstatus", "order_status").select(*reversed(schema)), path, schema)
    return parquet.read(spark, path, schema)


def _models(spark: SparkSession, d: str) -> DataFrame:
    """Every model of a scenario, built, and rows by which two of them differ from plain SQL over the raw tables."""
    built = prepare(spark, resolve(document.parse(load("library_loans_001"))), 0, f"{shared_folder(spark)}/instances-{uuid.uuid4().hex}")
    names = {t: f"{t}_{uuid.uuid4().hex}" for t in built.record["raw"]}
    for t, view in names.items():
        built.table(spark, t).createOrReplaceTempView(view)
    plain = {
        "j_full": "SELECT loan_id, CASE WHEN lower(genre) = 'n/a' THEN 'unknown' ELSE lower(genre) END AS genre, price, days - 28 AS late_days, year(lent_on) AS year, upper(trim(town)) AS town FROM {raw_loans} LEFT JOIN {raw_books} USING (book_id) JOIN {raw_readers} USING (reader_id) WHERE days > 1",
        "o_loans_by_town": "SELECT upper(trim(town)) AS town, year(lent_on) AS year, count(*) AS n_loans, count_if(days > 28) AS late FROM {raw_loans} JOIN {raw_readers} USING (reader_id) WHERE days > 1 GROUP BY 1, 2",
    }
    found = [(model, n > 0, False, 0) for model, n in built.record["models"].items() if model not in plain]
    for model, sql in plain.items():
        expected, rows = spark.sql(sql.format(**names)), built.table(spark, model)
        rows = rows.select(*[name(c).cast(expected.schema[c].dataType).alias(c) for c in expected.columns])
        found.append((model, not rows.isEmpty(), True, rows.exceptAll(expected).count() + expected.exceptAll(rows).count()))
    for view in names.values():
        spark.catalog.dropTempView(view)
    return spark.createDataFrame(found, "model string, filled boolean, compared boolean, different bigint")


_register("io_parquet_sink", _sink, "SELECT o_orderstatus AS order_status, o_orderkey, o_totalprice, o_orderpriority FROM orders")
_register("io_models", _models, "SELECT model, true AS filled, compared, CAST(0 AS BIGINT) AS different FROM (VALUES ('stg_readers', false), ('stg_books', false), ('stg_loans', false), ('j_loans_books', false), ('j_full', true), ('o_loans_by_town', true), ('o_value_by_genre', false)) t(model, compared)")
