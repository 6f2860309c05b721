import duckdb
import pytest

from layerloom import queries
from layerloom.operators import checks, models
from layerloom.operators.preview import cell, checksum, preview
from layerloom.spec import model as m
from layerloom.spec.shapes import Object

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return found


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, duck, key):
    df = queries.QUERIES[key](spark, DATA)
    cursor = duck.execute(queries.ORACLES[key])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cursor.fetchall())


def staging(**spec):
    return Object(m.StagingModel).read({"name": "s", "source": "r", "grain": ["a"], **spec}, "")


def table(spark, values, types="a bigint, b string"):
    return spark.createDataFrame(values, types)


KEEP_FIRST = {"op": "filter", "condition": {"kind": "comparison", "operator": "eq", "left": {"kind": "column", "column": "a"}, "right": {"kind": "literal", "value": 1}}}


@pytest.mark.parametrize("operation", [{"op": "cast", "type": "integer"}, {"op": "map_values", "mapping": {"1": "x"}, "on_unmapped": "error"}])
def test_a_bad_value_raises_though_a_filter_drops_its_row(spark, operation):
    source, schema = table(spark, [(1, "1"), (2, "bad")]), {"a": "integer", "b": "string"}
    columns = [{"source": "a", "target": "a"}, {"source": "b", "target": "b", "operations": [operation]}]
    with pytest.raises(Exception):
        models.staging(staging(columns=columns, row_operations=[KEEP_FIRST]), source, schema)[0].select("a").collect()
    lazily = models.staging(staging(columns=columns, row_operations=[KEEP_FIRST]), source, schema, barrier=lambda df: df)[0]
    assert lazily.select("a").count() == 1  # what the barrier is there for


def test_overflow_raises_though_a_filter_drops_its_row(spark):
    add = {"kind": "binary", "operator": "add", "left": {"kind": "column", "column": "a"}, "right": {"kind": "literal", "value": 2**62}}
    spec = {"operation": "transform", "name": "t", "source": "r", "grain": ["a"], "columns": [{"source": "a", "target": "a"}], "derived_columns": [{"name": "c", "type": "integer", "expression": add}], "filters": [KEEP_FIRST["condition"]]}
    with pytest.raises(Exception, match="OVERFLOW"):
        models.transform(Object(m.Transform).read(spec, ""), table(spark, [(1, ""), (2**62, "")]), {"a": "integer", "b": "string"})[0].count()


def test_deduplication_orders_nulls_last_and_groups_null_keys(spark):
    df = table(spark, [(1, None), (2, "x"), (3, "y"), (None, "z"), (None, None)])
    first = lambda direction: Object(m.DeduplicateRows).read({"op": "deduplicate", "keys": ["k"], "order_by": [{"column": "b", "direction": direction}]}, "")
    keyed = df.selectExpr("case when a is null then null else 1 end as k", "b")
    for direction, best in (("asc", "x"), ("desc", "y")):
        op = first(direction)
        assert {tuple(r) for r in models.first_of_each(keyed, op.keys, op.order_by).collect()} == {(1, best), (None, "z")}


def test_null_keys_join_nothing(spark):
    spec = {"operation": "join", "name": "j", "left": "l", "right": "r", "join": {"type": "left", "on": [{"left": "a", "right": "a"}, {"left": "b", "right": "b"}]}, "grain": ["a"], "columns": [{"side": "left", "source": "a", "target": "x"}, {"side": "right", "source": "a", "target": "y"}]}
    side = (table(spark, [(1, "k"), (2, None), (None, "k")]), {"a": "integer", "b": "string"})
    for kind, expected in (("left", {(1, 1), (2, None), (None, None)}), ("inner", {(1, 1)})):
        spec["join"]["type"] = kind
        assert {tuple(r) for r in models.join(Object(m.JoinModel).read(spec, ""), side, side)[0].collect()} == expected


def test_metrics_at_the_edge(spark):
    big = 2**63 - 1
    df, schema = table(spark, [(1, big, 0.0), (1, big, -0.0), (1, None, float("nan")), (None, 3, float("nan"))], "k bigint, i bigint, f double"), {"k": "integer", "i": "integer", "f": "float"}
    metrics = [{"name": n, "function": f, "column": c} for n, f, c in (("s", "sum", "i"), ("a", "avg", "i"), ("d", "count_distinct", "f"), ("x", "max", "f"), ("c", "count", "i"))]
    metrics += [{"name": "none", "function": "conditional_sum", "column": "i", "condition": {"kind": "is_null", "value": {"kind": "column", "column": "k"}}}]
    spec = {"operation": "aggregate", "name": "g", "source": "t", "group_by": [{"source": "k", "target": "i"}], "metrics": metrics, "grain": ["i"]}
    out = models.aggregate(Object(m.Aggregate).read(spec, ""), df, schema)[0]
    found = {r["i"]: r for r in out.collect()}
    assert set(found) == {1, None} and out.columns == ["i", "s", "a", "d", "x", "c", "none"]
    assert found[1]["s"] == float(2 * big) and found[1]["a"] == float(big) and found[1]["c"] == 2 and found[1]["none"] is None
    assert found[1]["d"] == 2 and found[1]["x"] != found[1]["x"] and found[None]["none"] == 3.0
    assert models.aggregate(Object(m.Aggregate).read(spec, ""), df.filter("false"), schema)[0].count() == 0


def violations(spark, spec, values, parent=None):
    kind = {"not_null": m.NotNull, "unique": m.Unique, "relationships": m.References, "accepted_values": m.AcceptedValues, "row_count": m.RowsBetween, "column_range": m.ColumnRange}[spec["type"]]
    assertion = Object(kind).read({"name": "x", "model": "t", **spec}, "")
    tables = {"t": table(spark, values)} | ({"p": table(spark, parent)} if parent is not None else {})
    found = {k: v.count() for k, v in checks.violations(assertion, tables)}
    if isinstance(assertion, checks.SINGLE_ROW):
        assert {k: bool(n) for k, n in checks.row_checks([assertion], tables).items()} == {k: bool(n) for k, n in found.items()}
    return sum(found.values())


@pytest.mark.parametrize(
    "spec,good,bad",
    [
        ({"type": "not_null", "columns": ["a", "b"]}, [(1, "x")], [(1, None)]),
        ({"type": "unique", "columns": ["a"]}, [(1, "x"), (2, "x"), (None, "x"), (None, "x")], [(1, "x"), (1, "y")]),
        ({"type": "unique", "columns": ["a", "b"]}, [(1, "x"), (1, "y"), (1, None), (1, None)], [(1, "x"), (1, "x")]),
        ({"type": "accepted_values", "column": "b", "values": ["x", "y"]}, [(1, "x"), (1, None)], [(1, "z")]),
        ({"type": "row_count", "min": 1, "max": 2}, [(1, "x")], []),
        ({"type": "row_count", "max": 1}, [], [(1, "x"), (2, "x")]),
        ({"type": "column_range", "column": "a", "min": 1, "max": 3}, [(1, ""), (3, ""), (None, "")], [(0, "")]),
        ({"type": "column_range", "column": "a", "min": 1, "max": 3, "inclusive": False}, [(2, "")], [(3, "")]),
    ],
)
def test_assertions_in_both_directions(spark, spec, good, bad):
    assert violations(spark, spec, good) == 0
    assert violations(spark, spec, bad) >= 1


def test_references(spark):
    one = {"type": "relationships", "columns": ["a"], "to_model": "p", "to_columns": ["a"]}
    two = {"type": "relationships", "columns": ["a", "b"], "to_model": "p", "to_columns": ["a", "b"]}
    parent = [(1, "x"), (1, "x"), (2, None)]
    assert violations(spark, one, [(1, ""), (None, "")], parent) == 0
    assert violations(spark, one, [(3, "")], parent) == 1
    assert violations(spark, two, [(1, "x"), (None, None)], parent) == 0
    assert violations(spark, two, [(1, None), (2, None), (None, "x"), (1, "y")], parent) == 4


def test_previews(spark):
    df = table(spark, [(3, "x" * 50), (None, None), (1, "b"), (2, "c"), (5, "e"), (4, "d")])
    assert preview(df, ("a",)) == [["a", "b"], ["1", "b"], ["2", "c"], ["3", "x" * 39 + "…"], ["4", "d"], ["5", "e"]]
    assert cell(None) == "NULL" and cell(True) == "true"
    assert checksum(df) == checksum(df.repartition(3)) != checksum(df.unionAll(df))
    odd = df.sparkSession.createDataFrame([(None,)], "a string"), df.sparkSession.createDataFrame([("\0null",)], "a string"), df.sparkSession.createDataFrame([("",)], "a string")
    assert len({checksum(x) for x in odd}) == 3
    assert checksum(df.unionAll(df)) != checksum(df.unionAll(df).unionAll(df).unionAll(df))
    assert checks.check_name("a" * 64) == "a" * 64 and len(checks.check_name("a" * 65)) == 64


def test_plans_push_down_and_prune(spark):
    text = queries.QUERIES["stg_filter"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(value), IsNotNull(event_type), GreaterThan(value,50.0)" in text
    plan = queries.QUERIES["m_count"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_brand:string,p_size:int>" in plan
    dedup = queries.QUERIES["int_dedup"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in dedup
