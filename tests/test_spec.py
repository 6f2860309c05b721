import copy
import json

import pytest

from layerloom.errors import ParseError
from layerloom.spec import document


def parse(value):
    return document.parse(json.dumps(value))


def code(value) -> tuple[str, str]:
    with pytest.raises(ParseError) as e:
        parse(value)
    return e.value.code, e.value.path


def test_round_trip_and_hash(scenario):
    for name in ("library_loans_001", "tours_guides_001"):
        found = parse(scenario(name))
        again = document.parse(document.canonical(found))
        assert again == found and document.content_hash(again) == document.content_hash(found)


def test_hash_ignores_spelling_not_meaning(scenario):
    a, b = scenario("tours_guides_001"), scenario("tours_guides_001")
    b["raw_tables"][2]["columns"][2]["generator"]["min"] = "2024-01-01T02:00:00+02:00"  # the same instant
    b["raw_tables"][0]["columns"][0]["nullable"] = False  # a default written out
    assert document.content_hash(parse(a)) == document.content_hash(parse(b))
    b["raw_tables"][0]["rows"]["max"] += 1
    assert document.content_hash(parse(a)) != document.content_hash(parse(b))


@pytest.mark.parametrize(
    "change",
    [
        lambda s: s.update(schema_version=1.0),
        lambda s: s.update(surprise=1),
        lambda s: s.pop("domain"),
        lambda s: s.update(scenario_id="Upper"),
        lambda s: s["raw_tables"].pop(),
        lambda s: s["raw_tables"][0]["rows"].update(min=0),
        lambda s: s["raw_tables"][0]["rows"].update(max=1),
        lambda s: s["raw_tables"][0]["rows"].update(max=True),
        lambda s: s["raw_tables"][0]["columns"][0].update(null_probability=0.5),
        lambda s: s["raw_tables"][0]["columns"][0].update(null_probability=1),
        lambda s: s["raw_tables"][0]["columns"].append(s["raw_tables"][0]["columns"][0]),
        lambda s: s["raw_tables"][0]["columns"][2]["generator"].update(weights=[0.0, 0.0, 0.0]),
        lambda s: s["raw_tables"][0]["columns"][2]["generator"].update(weights=[1.0]),
        lambda s: s["raw_tables"][0]["columns"][2]["generator"].update(values=["a", "a", "b"]),
        lambda s: s["raw_tables"][0]["columns"][1]["generator"].update(locale="en_US"),
        lambda s: s["raw_tables"][1]["columns"][1]["generator"].update(alphabet="aa"),
        lambda s: s["raw_tables"][1]["columns"][1]["generator"].update(min_length=21),
        lambda s: s["raw_tables"][1]["columns"][3]["generator"].update(min=5),
        lambda s: s["raw_tables"][2]["columns"][3]["generator"].update(min="2023-02-30"),
        lambda s: s["raw_tables"][2]["columns"][0]["generator"].update(min=100000),
        lambda s: s["staging_models"][0]["columns"][1]["operations"].append({"op": "replace", "old": "", "new": "x"}),
        lambda s: s["staging_models"][0]["columns"][1]["operations"].append({"op": "cast", "type": "integer", "format": "%d"}),
        lambda s: s["staging_models"][0]["columns"].append(s["staging_models"][0]["columns"][0]),
        lambda s: s["intermediate_models"][0]["join"]["on"].append(s["intermediate_models"][0]["join"]["on"][0]),
        lambda s: s["intermediate_models"][0].update(operation="union"),
        lambda s: s["intermediate_models"][0]["derived_columns"][0].update(name="days"),
        lambda s: s["output_models"][0]["metrics"][0].update(name="town"),
        lambda s: s["tests"][1].update(min=None, max=None),
        lambda s: s["tests"].append({"name": "r", "model": "x", "type": "row_count", "min": 3, "max": 2}),
    ],
)
def test_malformed(scenario, change):
    value = scenario()
    change(value)
    assert code(value)[0] == "P004"


def test_template_and_timestamp_rules(scenario):
    value = scenario("tours_guides_001")
    for template in ("no placeholder", "{tour_id", "{a.b}", "{{tour_id}}", "{tour_id!r}"):
        value["raw_tables"][1]["columns"][1]["generator"]["template"] = template
        assert code(value)[0] == "P004"
    value = scenario("tours_guides_001")
    value["raw_tables"][2]["columns"][2]["generator"]["min"] = "2024-01-01T00:00:00"
    assert code(value) == ("P004", "raw_tables.2.columns.2.generator.min")


def test_duplicate_keys_size_depth_and_encoding(scenario):
    with pytest.raises(ParseError, match="P001"):
        document.parse('{"a": 1, "a": 2}')
    with pytest.raises(ParseError, match="P002"):
        document.parse(json.dumps(scenario()), most_bytes=100)
    for bad in (b"\xff", "{", "[1", "NaN"):
        with pytest.raises(ParseError, match="P004"):
            document.parse(bad)
    value = scenario()
    node = {"kind": "column", "column": "days"}
    for _ in range(16):
        node = {"kind": "binary", "operator": "add", "left": node, "right": {"kind": "literal", "value": 1}}
    value["intermediate_models"][0]["derived_columns"][0]["expression"] = node
    assert code(value)[0] == "P003"
    value["intermediate_models"][0]["derived_columns"][0]["expression"] = node["left"]
    parse(value)
    deep = {"kind": "is_null", "value": {"kind": "column", "column": "late_days"}}
    for _ in range(16):
        deep = {"kind": "not", "condition": deep}
    value["output_models"][0]["metrics"][1]["condition"] = deep  # conditions of metrics count too
    assert code(value)[0] == "P003"


def test_scalars_are_not_converted(scenario):
    value = scenario()
    value["tests"][0]["values"] = ["JENA", 1, 1.0, True]
    found = parse(value).tests[0].values
    assert [type(v) for v in found] == [str, int, float, bool]


def test_json_schema_is_closed():
    schema = document.json_schema()
    objects = [d for d in schema["$defs"].values() if d.get("type") == "object"]
    assert len(objects) > 50 and all(d["additionalProperties"] is False for d in objects)
    assert schema["$defs"]["Scenario"]["properties"]["schema_version"] == {"const": "1.0"}
    text = json.dumps(schema)
    assert all(f"#/$defs/{ref}" not in text or ref in schema["$defs"] for ref in schema["$defs"])
    assert copy.deepcopy(schema) == document.json_schema()
