import json
from pathlib import Path

import pytest

from layerloom import run
from layerloom.cli import main
from layerloom.errors import StageError
from layerloom.features import Request, example_pair, features, shown, size_class, unmet
from layerloom.files import Store
from layerloom.plans import resolve
from layerloom.spec import document

NAME = "library_loans_001"


def source(value):
    return json.dumps(value)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    from layerloom.cli import load

    root = str(tmp_path_factory.mktemp("root"))
    return root, run.prepare_json(spark, load(NAME), 0, root)


def test_an_instance_holds_all_tables(spark, built):
    root, instance = built
    plan = resolve(document.parse(Store(spark).read(f"{instance.path}/scenario.json")))
    assert not instance.reused and set(instance.record["models"]) == set(plan.order)
    assert all(n == 0 for n in instance.record["checks"].values()) and len(instance.record["checks"]) > 30
    for name, schema in plan.schemas.items():
        assert instance.table(spark, name).columns == list(schema)
    lent = instance.table(spark, "j_full").groupBy("town", "year").count().collect()
    assert {(r["town"], r["year"], r["count"]) for r in lent} == {(r["town"], r["year"], r["n_loans"]) for r in instance.table(spark, "o_loans_by_town").collect()}


def test_it_is_found_again_but_not_if_broken(spark, built, scenario):
    root, instance = built
    again = run.prepare_json(spark, source(scenario()), 0, root)
    assert again.reused and again.record == instance.record
    store, work = Store(spark), f"{root}/copy"
    store.copy(instance.path, work)
    wanted = instance.record["identity"]
    assert run.verified(store, work, wanted)
    assert run.verified(store, work, "0" * 64) is None
    store.write(f"{work}/scenario.json", "{}")
    assert run.verified(store, work, wanted) is None
    store.delete(f"{work}/SUCCESS")
    assert run.verified(store, work, wanted) is None
    store.copy(instance.path, f"{root}/copy2")
    store.delete(f"{root}/copy2/models/j_full")
    assert run.verified(store, f"{root}/copy2", wanted) is None


def test_a_table_file_of_the_same_size_is_noticed(spark, built):
    root, instance = built
    store, work = Store(spark), f"{root}/copy3"
    store.copy(instance.path, work)
    assert run.verified(store, work, instance.record["identity"])
    name = next(f for f in instance.record["files"] if f.startswith("models/j_full/"))
    path = Path(work, name)
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 1
    path.unlink()
    path.with_name(f".{path.name}.crc").unlink(missing_ok=True)  # as if another program had replaced it
    path.write_bytes(data)
    assert path.stat().st_size == instance.record["files"][name]
    assert run.verified(store, work, instance.record["identity"]) is None


def test_identity_depends_on_meaning_and_seed(scenario):
    a = document.parse(source(scenario()))
    assert run.identity(a, 0) == run.identity(document.parse(document.canonical(a)), 0) != run.identity(a, 1)


FAILING = [
    ({"name": "t", "model": "o_loans_by_town", "type": "row_count", "min": 1000}, "t"),
    ({"name": "t", "model": "raw_loans", "type": "column_range", "column": "days", "min": 100, "max": 200}, "t"),
    ({"name": "t", "model": "raw_loans", "type": "unique", "columns": ["reader_id", "returned"]}, "t"),
    ({"name": "t", "model": "stg_books", "type": "relationships", "columns": ["book_id"], "to_model": "stg_readers", "to_columns": ["reader_id"]}, "t"),
    ({"name": "t", "model": "j_full", "type": "accepted_values", "column": "town", "values": ["JENA"]}, "t"),
    ({"name": "t", "model": "j_loans_books", "type": "not_null", "columns": ["genre", "price"]}, "t__genre"),
]


@pytest.mark.parametrize("test,check", FAILING)
def test_a_broken_assertion_stops_the_build(spark, scenario, tmp_path, test, check):
    s = scenario()
    s["tests"].append(test)
    with pytest.raises(StageError) as e:
        run.prepare_json(spark, source(s), 0, str(tmp_path))
    assert e.value.stage == "test" and check in e.value.details
    failures = list((tmp_path / "failures").glob("*.json"))
    assert len(failures) == 1 and json.loads(failures[0].read_text())["stage"] == "test"
    assert not list(tmp_path.glob("instances/*")) and not list(tmp_path.glob("building/*"))


def test_failures_name_their_stage(spark, scenario, tmp_path):
    root = str(tmp_path)
    for text, stage in (("{", "parse"), (source(scenario() | {"tests": [{"name": "x", "model": "nothing", "type": "row_count", "min": 1}]}), "resolve")):
        with pytest.raises(StageError) as e:
            run.prepare_json(spark, text, 0, root)
        assert e.value.stage == stage
    s = scenario()
    s["staging_models"][0]["columns"][1]["operations"].append({"op": "map_values", "mapping": {"JENA": "x"}, "on_unmapped": "error"})
    s["tests"] = s["tests"][1:]
    with pytest.raises(StageError, match="unmapped value in stg_readers.town") as e:
        run.prepare_json(spark, source(s), 0, root)
    assert e.value.stage == "build" and "KASSEL" not in str(e.value)


def test_command_line(spark, built, capsys):
    root, instance = built
    assert main(["open", NAME, "--root", root], spark) == 0
    out = capsys.readouterr().out
    assert "found (small)" in out and "o_loans_by_town" in out and "JENA" in out
    assert main(["seed", NAME, "5", "--root", root], spark) == 0
    assert main(["list", "--root", root], spark) == 0
    assert f"{NAME} (seeds 0, 5)" in capsys.readouterr().out
    assert main(["open", "nothing", "--root", root], spark) == 1
    assert main(["delete", "../x", "--root", root], spark) == 1
    five = next(r for r in __import__("layerloom.cli", fromlist=["instances"]).instances(Store(spark), root) if r["seed"] == 5)
    assert main(["delete", five["identity"], "--root", root], spark) == 0
    assert main(["delete", five["identity"], "--root", root], spark) == 1


def test_features_and_requests(scenario):
    found = {name: features(resolve(document.parse(source(scenario(name))))) for name in (NAME, "tours_guides_001")}
    a, b = found[NAME], found["tours_guides_001"]
    assert a.staging == {"trim", "upper", "lower", "map_values", "filter"} and a.joins == {"left", "inner"} and a.intermediate == {"derive"}
    assert b.composite_key and b.intermediate == {"deduplicate"} and b.metrics == {"count_distinct", "max", "conditional_sum"}
    wanted = Request(scenario_id=NAME, domain="library", joins="mixed", staging="trim, upper", metrics=["sum"], composite_keys="forbidden")
    assert unmet(a, wanted) == ()
    assert {u.code for u in unmet(b, wanted)} == {"id-mismatch", "domain-mismatch", "staging-missing", "join-mode-mismatch", "metric-missing", "composite-key-mismatch"}
    assert ("joins", "mixed") in shown(a, wanted) and example_pair([a, b], wanted) == (NAME, "tours_guides_001")
    assert Request(**wanted.to_dict()) == wanted
    for bad in ({"size": "huge"}, {"staging": "explode"}, {"seed": -1}, {"scenario_id": "X"}, {"joins": "cross"}):
        with pytest.raises(ValueError):
            Request(**({"scenario_id": "a", "domain": "d"} | bad))
    assert [size_class(n) for n in (1, 1000, 1001, 10_000, 100_000, 100_001)] == ["small", "small", "medium", "medium", "large", "outside-presets"]


def test_streaming_rows(spark, tmp_path):
    from layerloom.spec import model as m
    from layerloom.spec.shapes import Object
    from layerloom.streaming import apply_rows

    spark.createDataFrame([(1, " x "), (2, " y ")], "a bigint, b string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a bigint, b string").parquet(str(tmp_path / "in"))
    spec = {"name": "s", "source": "r", "grain": ["a"], "columns": [{"source": "a", "target": "a"}, {"source": "b", "target": "b", "operations": [{"op": "trim"}, {"op": "upper"}]}]}
    q = apply_rows(Object(m.StagingModel).read(spec, ""), stream, {"a": "integer", "b": "string"}).writeStream.format("memory").queryName("staged").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("staged").collect()} == {(1, "X"), (2, "Y")}
    spec["row_operations"] = [{"op": "deduplicate", "keys": ["a"], "order_by": [{"column": "b"}]}]
    with pytest.raises(ValueError):
        apply_rows(Object(m.StagingModel).read(spec, ""), stream, {"a": "integer", "b": "string"})
