"""Rules for raw tables, their generators and relationships; the links that follow from them."""

from __future__ import annotations

from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter

from layerloom.plans.resolved import Link
from layerloom.sources.domains import domain_size
from layerloom.spec import model as m
from layerloom.types import BOOLEAN, DATE, FLOAT, INTEGER, STRING, TIMESTAMP, scalar_type

Report = Callable[[str, str, str], None]
"""(code, path, message)"""

_MAKES = {
    m.FormattedId: STRING, m.IntegerRange: INTEGER, m.FloatRange: FLOAT, m.DateRange: DATE, m.TimestampRange: TIMESTAMP,
    m.BooleanDraw: BOOLEAN, m.RandomString: STRING, m.Template: STRING,
}


def check_tables(scenario: m.Scenario, report: Report) -> None:
    relationships = {r.name for r in scenario.relationships}
    for table in scenario.raw_tables:
        at, columns = f"raw_tables[{table.name}]", {c.name: c for c in table.columns}
        for key in table.primary_key:
            if key not in columns:
                report("E106", f"{at}.primary_key", f"no column {key}")
            elif columns[key].nullable:
                report("E106", f"{at}.primary_key", f"key column {key} is nullable")
        _check_capacity(table, columns, at, report)
        for c in table.columns:
            _check_generator(c, f"{at}.columns[{c.name}]", columns, relationships, report)
        templates = {c.name: [p for p in c.generator.parts if p in columns and p != c.name] for c in table.columns if isinstance(c.generator, m.Template)}
        try:
            list(TopologicalSorter(templates).static_order())
        except CycleError as e:
            report("E110", f"{at}.columns", f"templates need each other: {' -> '.join(e.args[1])}")


def _check_generator(c: m.RawColumn, at: str, columns: dict[str, m.RawColumn], relationships: set[str], report: Report) -> None:
    g = c.generator
    match g:
        case m.Categorical():
            kinds = {scalar_type(v) for v in g.values}
            if kinds != {c.type}:
                if len(kinds) > 1 or c.type not in (DATE, TIMESTAMP):
                    report("E108", f"{at}.generator.values", f"values must all be of type {c.type}")
                else:
                    report("E107", f"{at}.generator", f"categorical makes no {c.type}")
        case m.ForeignKey():
            if g.relationship not in relationships:
                report("E105", f"{at}.generator.relationship", f"no relationship {g.relationship}")
        case m.Template():
            if c.type != STRING:
                report("E107", f"{at}.generator", f"template_string makes no {c.type}")
            for p in g.parts:
                if p not in columns or p == c.name:
                    report("E109", f"{at}.generator.template", f"{{{p}}} names no other column")
        case _ if isinstance(g, m.PLAUSIBLE):
            if c.type != STRING:
                report("E112", f"{at}.generator", f"{g.kind} makes strings only")
        case _:
            if _MAKES[type(g)] != c.type:
                report("E107", f"{at}.generator", f"{g.kind} makes no {c.type}")


def _check_capacity(table: m.RawTable, columns: dict[str, m.RawColumn], at: str, report: Report) -> None:
    """Keys and identifiers must have room for the most rows, wherever the room can be told."""
    most = table.rows.max
    sizes = {name: domain_size(c.generator) for name, c in columns.items()}
    key = [sizes.get(k) for k in table.primary_key]
    if key and all(s is not None for s in key):
        room = 1
        for s in key:
            room *= s
        if room < most:
            report("E106", f"{at}.primary_key", f"{room} keys for up to {most} rows")
    for c in table.columns:
        size = sizes[c.name]
        counted = isinstance(c.generator, m.FormattedId) or (c.unique and not c.nullable and c.name not in table.primary_key)
        if counted and size is not None and size < most:
            report("E106", f"{at}.columns[{c.name}]", f"{size} values for up to {most} rows")


def _is_unique(table: m.RawTable, columns: tuple[str, ...]) -> bool:
    """The columns are the primary key, or each is unique by itself."""
    unique = {c.name for c in table.columns if c.unique}
    return (bool(columns) and set(columns) == set(table.primary_key)) or all(c in unique for c in columns)


def _points(table: m.RawTable, columns: tuple[str, ...], relationship: str, side: str) -> bool:
    """All of the columns are made as foreign keys of the relationship towards the side."""
    by_name = {c.name: c.generator for c in table.columns}
    wanted = m.ForeignKey(relationship=relationship, target_side=side)
    return all(by_name.get(c) == wanted for c in columns)


def links_of(scenario: m.Scenario, report: Report) -> tuple[Link, ...]:
    """Checks all relationships and returns the foreign keys that they declare."""
    raw = {t.name: t for t in scenario.raw_tables}
    links: list[Link] = []
    for i, r in enumerate(scenario.relationships):
        at = f"relationships[{i}]"
        ends = {"left": r.left, "right": r.right}
        if not all([_endpoint_exists(raw, e.table, e.columns, f"{at}.{side}", report) for side, e in ends.items()]):
            continue
        if isinstance(r, m.ManyToMany):
            links += _bridge_links(raw, r, at, report)
            continue
        if len(r.left.columns) != len(r.right.columns):
            report("E113", at, "both ends must name as many columns")
            continue
        _same_types(raw, r.left.table, r.left.columns, r.right.table, r.right.columns, at, report)
        unique = {side: _is_unique(raw[e.table], e.columns) for side, e in ends.items()}
        if isinstance(r, m.OneToOne):
            if not all(unique.values()):
                report("E116", at, "both ends must be unique")
            pointing = [side for side, other in (("left", "right"), ("right", "left")) if _points(raw[ends[side].table], ends[side].columns, r.name, other)]
            if len(pointing) != 1:
                report("E111", at, "exactly one end must be a foreign key to the other")
                continue
            child = pointing[0]
        else:
            child = "right" if isinstance(r, m.OneToMany) else "left"
        parent = "left" if child == "right" else "right"
        if not isinstance(r, m.OneToOne):
            if not unique[parent]:
                report("E115", f"{at}.{parent}", "this end must be unique")
            if not _points(raw[ends[child].table], ends[child].columns, r.name, parent):
                report("E111", f"{at}.{child}", f"all columns must be foreign keys to the {parent} side")
        links.append(Link(r.name, r.cardinality, ends[child].table, ends[child].columns, ends[parent].table, ends[parent].columns, parent))
    _check_ownership(raw, links, scenario, report)
    _check_cycles(raw, links, report)
    return tuple(links)


def _endpoint_exists(raw: dict[str, m.RawTable], table: str, columns: tuple[str, ...], at: str, report: Report, code: str = "E105") -> bool:
    if table not in raw:
        report(code, f"{at}.table", f"no raw table {table}")
        return False
    missing = [c for c in columns if c not in {x.name for x in raw[table].columns}]
    for c in missing:
        report(code, f"{at}.columns", f"{table} has no column {c}")
    return not missing


def _same_types(raw: dict[str, m.RawTable], a: str, a_columns: tuple[str, ...], b: str, b_columns: tuple[str, ...], at: str, report: Report) -> None:
    kinds = {t: {c.name: c.type for c in raw[t].columns} for t in (a, b)}
    for x, y in zip(a_columns, b_columns, strict=False):
        if kinds[a][x] != kinds[b][y]:
            report("E114", at, f"{a}.{x} is {kinds[a][x]}, {b}.{y} is {kinds[b][y]}")


def _bridge_links(raw: dict[str, m.RawTable], r: m.ManyToMany, at: str, report: Report) -> list[Link]:
    b = r.bridge
    if b.table in (r.left.table, r.right.table):
        report("E117", f"{at}.bridge.table", "the bridge must differ from both ends")
        return []
    if not _endpoint_exists(raw, b.table, (*b.left_columns, *b.right_columns), f"{at}.bridge", report, "E117"):
        return []
    out = []
    for side, end, columns in (("left", r.left, b.left_columns), ("right", r.right, b.right_columns)):
        if len(end.columns) != len(columns):
            report("E113", f"{at}.bridge.{side}_columns", f"must be as many as {side}.columns")
            continue
        _same_types(raw, b.table, columns, end.table, end.columns, f"{at}.bridge", report)
        if not _is_unique(raw[end.table], end.columns):
            report("E115", f"{at}.{side}", "this end must be unique")
        if not _points(raw[b.table], columns, r.name, side):
            report("E111", f"{at}.bridge.{side}_columns", f"all columns must be foreign keys to the {side} side")
        out.append(Link(r.name, r.cardinality, b.table, columns, end.table, end.columns, side))
    return out


def _check_ownership(raw: dict[str, m.RawTable], links: list[Link], scenario: m.Scenario, report: Report) -> None:
    """One relationship owns a foreign key column, all of a key's parts are null together, and no part stands alone."""
    owner: dict[tuple[str, str], str] = {}
    for link in links:
        parts = [c for c in raw[link.child].columns if c.name in link.child_columns]
        if len({(c.nullable, c.null_probability) for c in parts}) > 1:
            report("E111", f"raw_tables[{link.child}].columns", f"parts of a key of {link.relationship} must be null together")
        for c in link.child_columns:
            if owner.setdefault((link.child, c), link.relationship) != link.relationship:
                report("E111", f"raw_tables[{link.child}].columns[{c}]", f"belongs to {owner[link.child, c]} and {link.relationship}")
    known = {r.name for r in scenario.relationships}
    linked = {link.relationship for link in links}
    for table in scenario.raw_tables:
        for c in table.columns:
            g = c.generator
            if isinstance(g, m.ForeignKey) and g.relationship in known & linked and not any(k.child == table.name and c.name in k.child_columns and (k.relationship, k.side) == (g.relationship, g.target_side) for k in links):
                report("E111", f"raw_tables[{table.name}].columns[{c.name}]", f"is no dependent column of {g.relationship}")


def _check_cycles(raw: dict[str, m.RawTable], links: list[Link], report: Report) -> None:
    """Key columns may not depend on each other in a circle."""
    needs: dict[tuple[str, str], set[tuple[str, str]]] = {}
    for link in links:
        for c in link.child_columns:
            needs.setdefault((link.child, c), set()).update((link.parent, p) for p in link.parent_columns)
    for table in raw.values():
        for c in table.columns:
            if isinstance(c.generator, m.Template):
                needs.setdefault((table.name, c.name), set()).update((table.name, p) for p in c.generator.parts)
    try:
        list(TopologicalSorter(needs).static_order())
    except CycleError as e:
        if len({t for t, _ in e.args[1]}) > 1 or any(isinstance(c.generator, m.ForeignKey) for t, n in e.args[1] for c in raw[t].columns if c.name == n):
            report("E135", "relationships", "keys need each other: " + " -> ".join(".".join(x) for x in e.args[1]))
