import datetime as dt
import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from layerloom.errors import StageError
from layerloom.operators import checks
from layerloom.plans import resolve
from layerloom.sources import parquet
from layerloom.sources.counts import row_counts
from layerloom.sources.random import permuted, permuted_product, stream, uniform
from layerloom.sources.synthetic import synthesise
from layerloom.sources.values import at_index, distinct, drawn, lattice_size
from layerloom.spec import document
from layerloom.spec import model as m


def plan_of(value):
    return resolve(document.parse(json.dumps(value)))


def values(spark, n, column):
    return [r[0] for r in spark.range(n).select(column(F.col("id"))).collect()]


def gen(**spec):
    return m.GENERATOR.read(spec, "")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 97, 1000])
def test_permutations_are_exact(spark, n):
    found = values(spark, n, lambda i: permuted(i, n, 42))
    assert sorted(found) == list(range(n))
    assert n < 50 or found != values(spark, n, lambda i: permuted(i, n, 43))


@pytest.mark.parametrize("n", [97, 997, 10007, 39989])
def test_permutations_of_prime_domains_are_no_shifts(spark, n):
    found = values(spark, n, lambda i: permuted(i, n, 42))
    assert sorted(found) == list(range(n))
    assert sum((b - a) % n == 1 for a, b in zip(found, found[1:], strict=False)) < 10
    assert len({(b - a) % n for a, b in zip(found, found[1:], strict=False)}) > n // 3


def test_vast_permutations_have_no_repeats(spark):
    assert len(set(values(spark, 5000, lambda i: permuted(i, 1 << 61, 7)))) == 5000


def test_streams_are_independent_and_uniform(spark):
    assert stream("a", 0, "x") == stream("a", 0, "x") and len({stream("a", 0, "x"), stream("a", 1, "x"), stream("b", 0, "x"), stream("a", 0, "y")}) == 4
    u = values(spark, 4000, lambda i: uniform(9, i))
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 4000 - 0.5) < 0.03


def test_each_kind_draws_from_its_domain(spark):
    draw = lambda n=2000, **spec: values(spark, n, lambda i: drawn(gen(**spec), i, 5))
    assert draw(3, kind="formatted_id", prefix="A-", digits=3, start=98) == ["A-098", "A-099", "A-100"]
    assert set(draw(kind="integer_range", min=-2, max=2)) == {-2, -1, 0, 1, 2}
    assert set(draw(kind="float_range", min=0.1, max=0.5, decimal_places=1)) == {0.1, 0.2, 0.3, 0.4, 0.5}
    days = set(draw(kind="date_range", min="2024-02-27", max="2024-03-01"))
    assert days == {dt.date(2024, 2, 27), dt.date(2024, 2, 28), dt.date(2024, 2, 29), dt.date(2024, 3, 1)}
    assert len(draw(kind="timestamp_range", min="2024-01-01T00:00:00+00:00", max="2024-01-01T00:00:00.000003+00:00")) == 2000
    counts = Counter(draw(kind="categorical", values=["a", "b", "c"], weights=[3.0, 1.0, 0.0]))
    assert set(counts) == {"a", "b"} and 1400 < counts["a"] < 1600
    assert set(draw(kind="categorical", values=[1.5, 2.5])) == {1.5, 2.5}
    assert 100 < sum(draw(kind="boolean", true_probability=0.1)) < 300
    words = draw(kind="random_string", min_length=2, max_length=4, alphabet="xy")
    assert {len(w) for w in words} == {2, 3, 4} and set("".join(words)) == {"x", "y"}
    for kind in ("person_name", "email", "city", "street_address", "company_name", "phone_number"):
        assert all(draw(50, kind=kind))


def test_distinct_draws(spark):
    draw = lambda n, **spec: values(spark, n, lambda i: distinct(gen(**spec), i, n, 5))
    assert sorted(draw(10, kind="integer_range", min=1, max=10)) == list(range(1, 11))
    assert len(set(draw(14, kind="random_string", min_length=1, max_length=3, alphabet="ab"))) == 14
    assert len(set(draw(500, kind="random_string", min_length=20, max_length=30))) == 500
    assert len(set(draw(5, kind="float_range", min=0.1, max=0.5, decimal_places=1))) == 5
    assert len(set(draw(200, kind="email"))) == 200
    assert sorted(draw(2, kind="categorical", values=["a", "b", "c"], weights=[1.0, 0.0, 9.0])) == ["a", "c"]
    for spec in ({"kind": "integer_range", "min": 1, "max": 3}, {"kind": "categorical", "values": ["a", "b"], "weights": [1.0, 0.0]}):
        with pytest.raises(StageError):
            draw(5, **spec)
    with pytest.raises(StageError):
        lattice_size(gen(kind="float_range", min=0.11, max=0.19, decimal_places=1))
    assert values(spark, 6, lambda i: at_index(gen(kind="random_string", min_length=1, max_length=2, alphabet="ab"), i)) == ["a", "b", "aa", "ba", "ab", "bb"]


def test_scenarios_keep_all_that_they_declare(spark, scenario):
    for name in ("library_loans_001", "tours_guides_001", "parcels_depots_001"):
        plan = plan_of(scenario(name))
        for seed in (0, 7):
            tables, counts = synthesise(spark, plan, seed)
            for t in plan.scenario.raw_tables:
                assert tables[t.name].count() == counts[t.name] and t.rows.min <= counts[t.name] <= t.rows.max
            for a in plan.derived:
                if a.model in tables:
                    for key, rows in checks.violations(a, tables):
                        assert rows.count() == 0, key


def test_rows_depend_on_seed_only(spark, scenario):
    plan = plan_of(scenario())
    take = lambda seed: {t: sorted(map(tuple, df.collect()), key=repr) for t, df in synthesise(spark, plan, seed)[0].items()}
    first = take(3)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert take(3) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert take(4) != first


def test_streams_are_isolated(spark, scenario):
    """A change of one column's generator leaves the others' values alone."""
    a, b = scenario(), scenario()
    b["raw_tables"][1]["columns"][3]["generator"]["max"] = 70.0
    before, after = (synthesise(spark, plan_of(s), 0)[0]["raw_books"].drop("price").collect() for s in (a, b))
    assert before == after


def test_nullable_foreign_keys_and_templates(spark, scenario):
    s = scenario()
    s["raw_tables"][2]["columns"][2]["null_probability"] = 0.5
    loans = synthesise(spark, plan_of(s), 0)[0]["raw_loans"]
    nulls, n = loans.filter("book_id is null").count(), loans.count()
    assert 0.35 < nulls / n < 0.65
    tours = synthesise(spark, plan_of(scenario("tours_guides_001")), 0)[0]["raw_tours"].collect()
    assert all(r["label"] == f"tour {r['tour_id']} ({r['level']})" for r in tours)


def test_keys_of_several_columns_are_null_together(spark, scenario):
    parcels = synthesise(spark, plan_of(scenario("parcels_depots_001")), 0)[0]["raw_parcels"].collect()
    assert all((r["depot_id"] is None) == (r["lane"] is None) for r in parcels)
    assert 0.1 < sum(r["lane"] is None for r in parcels) / len(parcels) < 0.3 and any(r["lane"] is None and r["grams"] is not None for r in parcels)


def test_counts_leave_room_for_one_to_one_keys(scenario):
    """Receipts may outnumber parcels by their bounds; they never do, and small tables aren't preferred for it."""
    plan = plan_of(scenario("parcels_depots_001"))
    found = [row_counts(plan, seed) for seed in range(200)]
    assert all(150 <= n["raw_receipts"] <= n["raw_parcels"] <= 500 and n["raw_lanes"] <= 6 * n["raw_depots"] for n in found)
    assert len({n["raw_parcels"] for n in found}) > 100 and len({n["raw_receipts"] for n in found}) > 100


def test_one_to_one_takes_each_parent_once(spark, scenario):
    s = scenario()
    s["relationships"][0]["cardinality"] = "one_to_one"
    s["raw_tables"][2]["columns"][1]["unique"] = True
    s["raw_tables"][2]["rows"] = {"min": 10, "max": 60}
    s["raw_tables"][0]["rows"] = {"min": 10, "max": 60}
    plan = plan_of(s)
    for seed in range(6):
        counts = row_counts(plan, seed)
        assert counts["raw_loans"] <= counts["raw_readers"]
    loans = synthesise(spark, plan, 1)[0]["raw_loans"]
    assert loans.select("reader_id").distinct().count() == loans.count()


LONG = {"kind": "random_string", "min_length": 12, "max_length": 12}
YEAR = {"kind": "timestamp_range", "min": "2024-01-01T00:00:00+00:00", "max": "2024-12-31T00:00:00+00:00"}
LEVEL = {"kind": "categorical", "values": ["a", "b", "never"], "weights": [1.0, 1.0, 0.0]}


@pytest.mark.parametrize("parts", [{"note": ("string", LONG)}, {"at": ("timestamp", YEAR)}, {"note": ("string", LONG), "at": ("timestamp", YEAR)}, {"level": ("string", LEVEL), "on": ("boolean", {"kind": "boolean", "true_probability": 0.0})}])
@pytest.mark.parametrize("first", [True, False])
def test_no_part_of_a_key_is_cut(spark, scenario, parts, first):
    """Strings, times and guides in either order: all guides and tours occur, times are from all months, tuples differ."""
    s = scenario("tours_guides_001")
    table, n = s["raw_tables"][2], 300
    table["rows"] = {"min": n, "max": n}
    extra = [{"name": c, "type": kind, "generator": g} for c, (kind, g) in parts.items()]
    table["columns"] = extra + table["columns"] if first else table["columns"] + extra
    table["primary_key"] = [c["name"] for c in table["columns"] if c["name"] in (*parts, "guide_id", "tour_id")]
    s["staging_models"][2]["columns"] += [{"source": c, "target": c} for c in parts]
    s["staging_models"][2]["row_operations"][0]["order_by"] += [{"column": c} for c in parts]
    built, counts = synthesise(spark, plan_of(s), 0)
    rows = built["raw_assignments"].collect()
    assert len(rows) == n == len({tuple(r[c] for c in table["primary_key"]) for r in rows})
    assert len({r["guide_id"] for r in rows}) == counts["raw_guides"] and len({r["tour_id"] for r in rows}) == counts["raw_tours"]
    if "at" in parts:
        assert {r["at"].month for r in rows} == set(range(1, 13))
    if "note" in parts:
        assert len({r["note"][0] for r in rows}) > 25
    if "level" in parts:
        assert {(r["level"], r["on"]) for r in rows} == {("a", False), ("b", False)}


@pytest.mark.parametrize("sizes", [[7, 5, 3], [2, 60], [1, 4], [11, 1, 2]])
def test_products_are_permuted_as_a_whole(spark, sizes):
    n = math.prod(sizes)
    found = [tuple(x) for x in values(spark, n, lambda i: permuted_product(i, sizes, 5))]
    assert len(set(found)) == n and all(0 <= x < size for row in found for x, size in zip(row, sizes, strict=True))


def test_vast_products_are_drawn_whole(spark):
    sizes = [1 << 62, 2, 1 << 52]
    found = [tuple(x) for x in values(spark, 2000, lambda i: permuted_product(i, sizes, 5))]
    assert len(set(found)) == 2000 and all(900 < sum(x[k] >= size // 2 for x in found) < 1100 for k, size in enumerate(sizes))


def test_no_room_for_keys_is_an_error(spark, scenario):
    s = scenario("tours_guides_001")
    s["raw_tables"][2]["rows"] = {"min": 400, "max": 500}
    with pytest.raises(StageError, match="room for 300"):
        row_counts(plan_of(s), 0)


SCHEMA = {"a": "integer", "b": "string", "c": "float", "d": "boolean", "e": "date", "f": "timestamp"}


def test_parquet_round_trip_and_refusals(spark, tmp_path):
    spec = "a bigint, b string, c double, d boolean, e date, f timestamp"
    rows = [(1, "ä'\n", 0.1, True, dt.date(2024, 2, 29), dt.datetime(2024, 1, 1, 1, 2, 3, 4)), (None,) * 6]
    df, path = spark.createDataFrame(rows, spec), str(tmp_path / "t")
    parquet.write(df, path, SCHEMA)
    assert sorted(map(tuple, parquet.read(spark, path, SCHEMA, 2).collect()), key=repr) == sorted(rows, key=repr)
    for wrong in (df.drop("a"), df.withColumn("z", F.lit(1)), df.withColumn("a", F.lit("x"))):
        with pytest.raises(StageError):
            parquet.write(wrong, path + "2", SCHEMA)
    with pytest.raises(StageError):
        parquet.read(spark, path, SCHEMA, 3)
    for other in ({"a": "integer"}, dict(reversed(SCHEMA.items())), SCHEMA | {"g": "string"}, SCHEMA | {"a": "float"}):
        with pytest.raises(StageError):
            parquet.read(spark, path, other)
    parquet.write(df.limit(1), path, SCHEMA)  # replaces, never adds
    assert parquet.read(spark, path, SCHEMA).count() == 1
