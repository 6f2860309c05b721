"""Row counts of raw tables: drawn from their intervals, and drawn anew where keys would not have room."""

from __future__ import annotations

from collections.abc import Callable

from layerloom.errors import StageError
from layerloom.plans.resolved import Link, ResolvedPlan
from layerloom.sources.domains import VAST, possible
from layerloom.sources.random import stream
from layerloom.spec import model as m

ROUNDS = 1000
Room = tuple[str, frozenset[str], Callable[[dict[str, int]], int]]
"""A table, the tables that its room depends on, and its most rows given their counts."""


def units(table: m.RawTable, links: tuple[Link, ...]) -> list[tuple[str, ...]]:
    """The table's columns, parts of one foreign key together, in the order of declaration."""
    keys = {c: k.child_columns for k in links if k.child == table.name for c in k.child_columns}
    out: list[tuple[str, ...]] = []
    for c in table.columns:
        unit = keys.get(c.name, (c.name,))
        if unit not in out:
            out.append(unit)
    return out


def key_units(table: m.RawTable, links: tuple[Link, ...]) -> list[tuple[str, ...]]:
    """The units that the primary key consists of, if whole units do."""
    found = [u for u in units(table, links) if set(u) & set(table.primary_key)]
    return found if found and all(set(u) <= set(table.primary_key) for u in found) else []


def without_replacement(table: m.RawTable, link: Link) -> bool:
    """Whether each parent key may occur once only: the link is 1:1, or the child columns are unique themselves."""
    unique = {c.name for c in table.columns if c.unique}
    own = set(link.child_columns)
    return link.cardinality == "one_to_one" or own == set(table.primary_key) or bool(own & unique) and (len(own) == 1 or own <= unique)


def unit_size(unit: tuple[str, ...], table: m.RawTable, links: tuple[Link, ...], counts: dict[str, int]) -> int | None:
    """How many values a unit of a key can take: parent rows for a foreign key."""
    for k in links:
        if k.child == table.name and k.child_columns == unit:
            return counts[k.parent]
    from layerloom.sources.values import lattice_size  # dates, timestamps and decimals have sizes too

    g = next(c.generator for c in table.columns if c.name == unit[0])
    return possible(g) or lattice_size(g)


def rooms(plan: ResolvedPlan) -> list[Room]:
    out: list[Room] = []
    for table in plan.raw.values():
        own = [k for k in plan.links if k.child == table.name]
        for k in own:
            if without_replacement(table, k) and not all(c.nullable for c in table.columns if c.name in k.child_columns):
                out.append((table.name, frozenset({k.parent}), lambda n, k=k: n[k.parent]))
        key = key_units(table, plan.links)
        if len(key) > 1:
            parents = frozenset(k.parent for k in own if k.child_columns in key)

            def product(n: dict[str, int], table: m.RawTable = table, key: list = key) -> int:
                room = 1
                for unit in key:
                    size = unit_size(unit, table, plan.links, n)
                    room = VAST if size is None else min(VAST, room * size)
                return room

            out.append((table.name, parents, product))
    return out


def row_counts(plan: ResolvedPlan, seed: int) -> dict[str, int]:
    """Rows of each raw table: uniform within its bounds, conditional on room for all keys."""
    tables, limits = plan.raw, rooms(plan)
    most = {t.name: t.rows.max for t in tables.values()}
    for _ in range(len(tables) + 1):  # what is at most possible, to a fixed point
        for child, _, room in limits:
            most[child] = min(most[child], room(most))
    for t in tables.values():
        if most[t.name] < t.rows.min:
            raise StageError("generate", f"{t.name} needs {t.rows.min} rows but has room for {most[t.name]}")

    def draw(name: str, round_: int) -> int:
        rows = tables[name].rows
        return rows.min + stream(plan.scenario.scenario_id, seed, f"rows/{name}/{round_}") % (rows.max - rows.min + 1)

    counts = {name: draw(name, 0) for name in tables}
    for round_ in range(1, ROUNDS):
        involved = {x for child, parents, room in limits if counts[child] > room(counts) for x in (child, *parents)}
        if not involved:
            return counts
        for name in sorted(involved):
            counts[name] = draw(name, round_)
    tied = {x for child, parents, _ in limits for x in (child, *parents)}
    return counts | {name: most[name] for name in tied}
