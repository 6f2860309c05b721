"""The resolved plan: all that compiling, generating and checking need to know."""

from __future__ import annotations

from dataclasses import dataclass

from layerloom.spec import model as m
from layerloom.types import Schema

Origin = tuple[str, str]
"""A raw table and one of its columns."""
Lineage = dict[str, frozenset[Origin]]


@dataclass(frozen=True)
class Link:
    """A foreign key: child columns that name parent columns, component by component."""

    relationship: str
    cardinality: str
    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    side: str  # of the relationship that the parent is on

    @property
    def pairs(self) -> tuple[tuple[Origin, Origin], ...]:
        return tuple(((self.child, c), (self.parent, p)) for c, p in zip(self.child_columns, self.parent_columns, strict=False))


@dataclass(frozen=True)
class ResolvedPlan:
    scenario: m.Scenario
    schemas: dict[str, Schema]
    lineage: dict[str, Lineage]
    links: tuple[Link, ...]
    order: tuple[str, ...]
    """All models in an order in which each comes after what it reads."""
    grains: dict[str, tuple[str, ...]]
    derived: tuple[m.Assertion, ...]

    @property
    def raw(self) -> dict[str, m.RawTable]:
        return {t.name: t for t in self.scenario.raw_tables}

    @property
    def models(self) -> dict[str, m.StagingModel | m.Intermediate | m.OutputModel]:
        s = self.scenario
        return {x.name: x for x in (*s.staging_models, *s.intermediate_models, *s.output_models)}

    def assertions(self) -> tuple[m.Assertion, ...]:
        """Explicit assertions first, then the derived ones that say something else."""
        seen, out = set(), []
        for a in (*self.scenario.tests, *self.derived):
            if (key := meaning(a)) not in seen:
                seen.add(key)
                out.append(a)
        return tuple(out)


def reads(model: m.StagingModel | m.Intermediate | m.OutputModel) -> tuple[str, ...]:
    return (model.left, model.right) if isinstance(model, m.JoinModel) else (model.source,)


def meaning(a: m.Assertion) -> tuple:
    """What an assertion says, whatever its name; scalars keep their type."""
    typed = lambda v: (type(v).__name__, v)
    match a:
        case m.NotNull() | m.Unique():
            return (a.model, a.type, a.columns)
        case m.AcceptedValues():
            return (a.model, a.type, a.column, tuple(map(typed, a.values)))
        case m.References():
            return (a.model, a.type, a.columns, a.to_model, a.to_columns)
        case m.RowsBetween():
            return (a.model, a.type, a.min, a.max)
    return (a.model, a.type, a.column, typed(a.min), typed(a.max), a.inclusive)
