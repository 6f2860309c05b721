"""Proofs for joins: the keys follow one declared relationship, and the declared grain survives."""

from __future__ import annotations

from layerloom.functions.expressions import columns_of
from layerloom.plans.raw_rules import Report
from layerloom.plans.resolved import Lineage, Link
from layerloom.spec import model as m


def _origin(lineage: Lineage, column: str) -> tuple[str, str] | None:
    found = lineage.get(column, frozenset())
    return next(iter(found)) if len(found) == 1 else None


def followed_link(model: m.JoinModel, left: Lineage, right: Lineage, links: tuple[Link, ...], at: str, report: Report) -> tuple[Link, str] | None:
    """The one link that the key pairs spell out in its declared order, and the side that its child is on."""
    for side in ("left", "right"):
        names = [getattr(k, side) for k in model.join.on]
        if len(set(names)) < len(names):
            report("E132", f"{at}.join.on", f"a key of the {side} side is mapped twice")
            return None
    pairs = tuple((_origin(left, k.left), _origin(right, k.right)) for k in model.join.on)
    turned = tuple((b, a) for a, b in pairs)
    found = [(link, side) for link in links for side, spelled in (("left", pairs), ("right", turned)) if link.pairs == spelled]
    if len(found) > 1:
        report("E132", f"{at}.join.on", f"the keys follow several relationships: {', '.join(sorted({k.relationship for k, _ in found}))}")
        return None
    if not found:
        report("E131", f"{at}.join.on", "the keys follow no declared relationship in its order")
        return None
    return found[0]


def check_grain(model: m.JoinModel, grains: dict[str, tuple[str, ...]], link: Link, child: str, at: str, report: Report) -> None:
    """The grain must cover what stays unique: the many side's key, or both sides' keys together.

    A left join keeps the left key if no row of it can meet several on the right; the right key never survives alone,
    since unmatched rows have none.
    """
    image = {}
    for side in ("left", "right"):
        targets = {c.source: c.target for c in model.columns if c.side == side}
        image[side] = {targets[c] for c in grains[getattr(model, side)] if c in targets}
    survivors = []
    if link.cardinality == "one_to_one":
        survivors = ["left"] if model.join.type == "left" else ["left", "right"]
    elif child == "left" or model.join.type == "inner":
        survivors = [child]
    covers = [image[s] for s in survivors] + ([image["left"] | image["right"]] if image["left"] and image["right"] else [])
    if not any(c and c <= set(model.grain) for c in covers):
        report("E133", f"{at}.grain", f"{', '.join(model.grain)} doesn't stay unique in this {model.join.type} join over {link.relationship}")
    if model.join.type == "left":
        sides = {c.target: c.side for c in model.columns}
        derived = {d.name: columns_of(d.expression) for d in model.derived_columns}
        for g in model.grain:
            found = {sides[c] for c in derived.get(g, {g}) if c in sides}
            if found == {"right"}:
                report("E136", f"{at}.grain", f"{g} is null where the left join finds nothing")
