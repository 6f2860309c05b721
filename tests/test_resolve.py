import json

import pytest

from layerloom.errors import SemanticError
from layerloom.plans import resolve
from layerloom.spec import document


def codes(value) -> set[str]:
    try:
        resolve(document.parse(json.dumps(value)))
    except SemanticError as e:
        assert list(e.issues) == sorted(e.issues)
        return set(e.codes)
    return set()


LIB, TOUR = "library_loans_001", "tours_guides_001"


def raw(s, table, column):
    return next(c for t in s["raw_tables"] if t["name"] == table for c in t["columns"] if c["name"] == column)


def model(s, name):
    return next(x for k in ("staging_models", "intermediate_models", "output_models") for x in s[k] if x["name"] == name)


def compare(column, value, op="gt"):
    return {"kind": "comparison", "operator": op, "left": {"kind": "column", "column": column}, "right": {"kind": "literal", "value": value}}


CASES = [
    (LIB, "E100", lambda s: (s["raw_tables"][1].update(name="raw_readers"))),
    (LIB, "E101", lambda s: s["intermediate_models"][1].update(name="stg_books")),
    (LIB, "E102", lambda s: model(s, "o_loans_by_town").update(name="raw_books")),
    (LIB, "E103", lambda s: s["relationships"][1].update(name="rel_reader_loans")),
    (LIB, "E104", lambda s: s["tests"][1].update(name="towns")),
    (LIB, "E105", lambda s: s["relationships"][0]["left"].update(table="raw_nobody")),
    (LIB, "E105", lambda s: model(s, "j_full").update(left="nothing")),
    (LIB, "E105", lambda s: s["tests"][1].update(column="nothing")),
    (LIB, "E106", lambda s: s["raw_tables"][0].update(primary_key=["nothing"])),
    (LIB, "E106", lambda s: raw(s, "raw_readers", "reader_id").update(nullable=True)),
    (LIB, "E106", lambda s: raw(s, "raw_loans", "loan_id")["generator"].update(max=500)),
    (LIB, "E106", lambda s: raw(s, "raw_readers", "reader_id")["generator"].update(digits=1)),
    (LIB, "E107", lambda s: raw(s, "raw_loans", "days").update(type="float")),
    (LIB, "E108", lambda s: raw(s, "raw_books", "genre")["generator"].update(values=["a", 1])),
    (LIB, "E108", lambda s: s["tests"][0].update(values=["JENA", 1])),
    (TOUR, "E109", lambda s: raw(s, "raw_tours", "label")["generator"].update(template="{nothing}")),
    (TOUR, "E109", lambda s: raw(s, "raw_tours", "label")["generator"].update(template="{label}")),
    (TOUR, "E110", lambda s: (raw(s, "raw_tours", "level").update(generator={"kind": "template_string", "template": "{label}"}), raw(s, "raw_tours", "label")["generator"].update(template="{level}"))),
    (LIB, "E111", lambda s: raw(s, "raw_loans", "reader_id")["generator"].update(target_side="right")),
    (TOUR, "E111", lambda s: raw(s, "raw_assignments", "tour_id").update(generator={"kind": "integer_range", "min": 1, "max": 999})),
    (LIB, "E112", lambda s: raw(s, "raw_loans", "days").update(generator={"kind": "city"})),
    (LIB, "E113", lambda s: s["relationships"][0]["left"].update(columns=["reader_id", "town"])),
    (LIB, "E114", lambda s: (raw(s, "raw_books", "book_id").update(type="integer", generator={"kind": "integer_range", "min": 1, "max": 99}))),
    (LIB, "E115", lambda s: s["raw_tables"][1].update(primary_key=[])),
    (LIB, "E116", lambda s: s["relationships"][1].update(cardinality="one_to_one")),
    (TOUR, "E117", lambda s: s["relationships"][0]["bridge"].update(table="raw_guides")),
    (TOUR, "E117", lambda s: s["relationships"][0]["bridge"].update(table="raw_nothing")),
    (LIB, "E118", lambda s: model(s, "stg_books").update(source="raw_loans")),
    (LIB, "E119", lambda s: model(s, "stg_books")["columns"][2].update(source="nothing")),
    (LIB, "E120", lambda s: model(s, "stg_books")["columns"][2].update(operations=[{"op": "trim"}])),
    (LIB, "E120", lambda s: model(s, "stg_books")["columns"][2].update(operations=[{"op": "null_if", "values": [1]}])),
    (LIB, "E120", lambda s: model(s, "stg_books")["columns"][2].update(operations=[{"op": "cast", "type": "date"}])),
    (LIB, "E121", lambda s: model(s, "stg_books").update(grain=["nothing"])),
    (LIB, "E122", lambda s: model(s, "j_loans_books").update(left="j_full")),
    (LIB, "E123", lambda s: model(s, "j_full").update(right="raw_readers")),
    (LIB, "E123", lambda s: model(s, "o_loans_by_town").update(source="stg_loans")),
    (LIB, "E124", lambda s: model(s, "j_full")["join"].update(on=[{"left": "loan_id", "right": "reader_id"}])),
    (LIB, "E124", lambda s: model(s, "j_full")["join"].update(on=[{"left": "nothing", "right": "reader_id"}])),
    (LIB, "E125", lambda s: model(s, "o_loans_by_town").update(grain=["n_loans"])),
    (LIB, "E125", lambda s: model(s, "o_loans_by_town").update(dimensions=["nothing"])),
    (LIB, "E126", lambda s: model(s, "o_value_by_genre")["metrics"][0].update(column="genre")),
    (LIB, "E126", lambda s: model(s, "o_value_by_genre")["metrics"][0].update(column="nothing")),
    (LIB, "E126", lambda s: model(s, "o_value_by_genre")["metrics"].append({"name": "x", "function": "max", "column": "genre"})),
    (LIB, "E127", lambda s: [x.update(source="j_loans_books") for x in s["output_models"]] and model(s, "o_loans_by_town").update(group_by=[{"source": "year", "target": "year"}, {"source": "genre", "target": "town"}])),
    (LIB, "E128", lambda s: s["tests"].append({"name": "again", "model": "stg_books", "type": "unique", "columns": ["book_id"]})),
    (LIB, "E128", lambda s: s["tests"].append(dict(s["tests"][0], name="again"))),
    (LIB, "E128", lambda s: s["tests"].append({"name": "none", "model": "o_loans_by_town", "type": "row_count", "max": 0})),
    (LIB, "E129", lambda s: model(s, "j_loans_books")["derived_columns"][0].update(type="float")),
    (LIB, "E129", lambda s: model(s, "j_loans_books")["derived_columns"][1]["expression"].update(value={"kind": "column", "column": "genre"})),
    (LIB, "E130", lambda s: model(s, "o_value_by_genre").update(filters=[{"kind": "in", "value": {"kind": "column", "column": "genre"}, "options": [1]}])),
    (LIB, "E131", lambda s: (model(s, "j_full")["join"].update(on=[{"left": "genre", "right": "town"}]))),
    (LIB, "E132", lambda s: (model(s, "j_full")["join"].update(on=[{"left": "reader_id", "right": "reader_id"}, {"left": "reader_id", "right": "town"}]))),
    (LIB, "E133", lambda s: model(s, "j_full").update(grain=["town"])),
    (TOUR, "E134", lambda s: model(s, "stg_assignments")["row_operations"][0].update(keys=["guide_id"])),
    (TOUR, "E134", lambda s: model(s, "d_best").update(order_by=[{"column": "rating"}])),
    (LIB, "E136", lambda s: (model(s, "j_loans_books")["columns"].append({"side": "right", "source": "book_id", "target": "book"}), model(s, "j_loans_books").update(grain=["loan_id", "book"]))),
    (LIB, "E999", lambda s: s["tests"][1].update(min=2.0)),
    (LIB, "E999", lambda s: model(s, "stg_loans")["row_operations"][0].update(condition=compare("days", "x"))),
]


@pytest.mark.parametrize("name,code,change", CASES, ids=[f"{c}-{i}" for i, (_, c, _) in enumerate(CASES)])
def test_defect_has_its_code(scenario, name, code, change):
    value = scenario(name)
    assert not codes(value)
    change(value)
    assert code in codes(value)


def test_foreign_key_cycle(scenario):
    s = scenario()
    raw(s, "raw_readers", "town").update(generator={"kind": "foreign_key", "relationship": "rel_back", "target_side": "left"})
    raw(s, "raw_loans", "reader_id")["unique"] = True
    s["relationships"].append({"name": "rel_back", "cardinality": "one_to_many", "left": {"table": "raw_loans", "columns": ["reader_id"]}, "right": {"table": "raw_readers", "columns": ["town"]}})
    s["relationships"][0]["left"]["columns"] = ["town"]
    raw(s, "raw_readers", "town")["unique"] = True
    assert "E135" in codes(s)


def test_left_join_to_the_many_side_needs_both_grains(scenario):
    s = scenario()
    j = model(s, "j_full")
    j.update(left="stg_readers", right="j_loans_books", grain=["reader_id"])
    j["join"]["type"] = "left"
    for c in j["columns"]:
        c["side"] = "left" if c["side"] == "right" else "right"
    j["columns"].append({"side": "left", "source": "reader_id", "target": "reader_id"})
    assert "E133" in codes(s)
    j["grain"] = ["loan_id"]
    assert {"E133", "E136"} <= codes(s)


def test_all_independent_defects_are_reported(scenario):
    s = scenario()
    raw(s, "raw_loans", "days")["type"] = "float"
    model(s, "stg_books")["grain"] = ["nothing"]
    s["tests"][0]["values"] = [1]
    assert {"E107", "E121", "E108"} <= codes(s)


def test_a_derived_column_sees_no_sibling(scenario):
    s = scenario()
    model(s, "j_loans_books")["derived_columns"].append({"name": "twice", "type": "integer", "expression": {"kind": "binary", "operator": "add", "left": {"kind": "column", "column": "late_days"}, "right": {"kind": "literal", "value": 1}}})
    assert codes(s) == {"E105"}


def test_plan_of_a_bundled_scenario(scenario):
    plan = resolve(document.parse(json.dumps(scenario())))
    assert plan.order == ("stg_readers", "stg_books", "stg_loans", "j_loans_books", "j_full", "o_loans_by_town", "o_value_by_genre")
    assert plan.schemas["j_full"] == {"loan_id": "integer", "genre": "string", "price": "float", "late_days": "integer", "year": "integer", "town": "string"}
    assert plan.lineage["j_full"]["late_days"] == {("raw_loans", "days")}
    derived = {a.name for a in plan.derived}
    assert {"derived_unique_stg_books", "derived_rel_rel_loan_book", "derived_row_count_o_loans_by_town", "derived_unique_o_loans_by_town"} <= derived
    assert len({a.name for a in resolve(plan.scenario, output_grain=False).derived}) < len(derived)
