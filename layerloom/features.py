"""What a scenario exercises, whether it meets a request, and which pairs of scenarios show the most of one.

Only the structure counts: an operation that is declared meets a requirement even if it changes no row.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from itertools import combinations

from layerloom.plans import ResolvedPlan
from layerloom.spec import model as m

#: Size classes by the most rows of a raw table.
SIZES = {"small": 1_000, "medium": 10_000, "large": 100_000}
KEYS, JOINS = ("auto", "required", "forbidden"), ("auto", "inner", "left", "mixed")
STAGING = ("trim", "lower", "upper", "replace", "map_values", "null_if", "coalesce", "cast", "filter", "deduplicate")
INTERMEDIATE = ("filter", "derive", "deduplicate")
METRICS = ("count_rows", "count", "count_distinct", "sum", "avg", "min", "max", "conditional_count", "conditional_sum")
_JOIN_SETS = {"inner": {"inner"}, "left": {"left"}, "mixed": {"inner", "left"}}


def size_class(rows: int) -> str:
    return next((name for name, most in SIZES.items() if rows <= most), "outside-presets")


@dataclass(frozen=True)
class Features:
    scenario_id: str
    domain: str
    composite_key: bool
    staging: frozenset[str]
    intermediate: frozenset[str]
    joins: frozenset[str]
    metrics: frozenset[str]
    most_rows: int


@dataclass(frozen=True)
class Request:
    scenario_id: str
    domain: str
    size: str = "small"
    composite_keys: str = "auto"
    staging: tuple[str, ...] = ()
    intermediate: tuple[str, ...] = ()
    joins: str = "auto"
    metrics: tuple[str, ...] = ()
    seed: int = 0

    def __post_init__(self):
        for name, value, pattern in (("scenario_id", self.scenario_id, r"[a-z][a-z0-9_]{0,99}"), ("domain", self.domain, r"[a-z][a-z0-9_]{0,62}")):
            if not isinstance(value, str) or not re.fullmatch(pattern, value):
                raise ValueError(f"invalid {name} {value!r}")
        for name, known in (("size", tuple(SIZES)), ("composite_keys", KEYS), ("joins", JOINS)):
            if getattr(self, name) not in known:
                raise ValueError(f"invalid {name} {getattr(self, name)!r}: one of {', '.join(known)}")
        for name, known in (("staging", STAGING), ("intermediate", INTERMEDIATE), ("metrics", METRICS)):
            raw = getattr(self, name) or ()
            items = {x.strip() for x in (raw.split(",") if isinstance(raw, str) else raw)} - {""}
            if strange := sorted(items - set(known)):
                raise ValueError(f"invalid {name} {strange[0]!r}: some of {', '.join(known)}")
            object.__setattr__(self, name, tuple(sorted(items)))
        if type(self.seed) is not int or not 0 <= self.seed < 2**63:
            raise ValueError(f"invalid seed {self.seed!r}")

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}


@dataclass(frozen=True)
class Unmet:
    code: str
    path: str
    message: str = field(compare=False)


def _derives(node: m.Expression) -> bool:
    """Arithmetic or a date part occurs somewhere in the expression."""
    return isinstance(node, m.Binary | m.DatePart) or (isinstance(node, m.Coalesce) and any(map(_derives, node.values)))


def features(plan: ResolvedPlan) -> Features:
    s = plan.scenario
    staged = {op.op for x in s.staging_models for c in x.columns for op in c.operations} | {op.op for x in s.staging_models for op in x.row_operations}
    inner = {
        "filter": any(getattr(x, "filters", ()) for x in s.intermediate_models),
        "derive": any(_derives(d.expression) for x in s.intermediate_models for d in getattr(x, "derived_columns", ())),
        "deduplicate": any(isinstance(x, m.Deduplicate) for x in s.intermediate_models),
    }
    return Features(
        s.scenario_id, s.domain, any(len(t.primary_key) > 1 for t in s.raw_tables), frozenset(staged), frozenset(k for k, has in inner.items() if has),
        frozenset(x.join.type for x in s.intermediate_models if isinstance(x, m.JoinModel)), frozenset(f.function for x in s.output_models for f in x.metrics), max(t.rows.max for t in s.raw_tables),
    )


def unmet(found: Features, wanted: Request) -> tuple[Unmet, ...]:
    """What of a request a scenario lacks, in a fixed order."""
    out = [Unmet(f"{what}-mismatch", path, f"{getattr(found, path)} is not {getattr(wanted, path)}") for what, path in (("id", "scenario_id"), ("domain", "domain")) if getattr(found, path) != getattr(wanted, path)]
    for code, path, needed, has in (("staging-missing", "staging", wanted.staging, found.staging), ("intermediate-missing", "intermediate", wanted.intermediate, found.intermediate)):
        out += [Unmet(code, path, f"{x} is absent") for x in needed if x not in has]
    if wanted.joins != "auto" and found.joins != _JOIN_SETS[wanted.joins]:
        out.append(Unmet("join-mode-mismatch", "joins", f"joins are {sorted(found.joins)}, not {wanted.joins}"))
    out += [Unmet("metric-missing", "output_models", f"{x} is absent") for x in wanted.metrics if x not in found.metrics]
    if not fits_keys(found, wanted.composite_keys):
        out.append(Unmet("composite-key-mismatch", "raw_tables", f"composite keys are {wanted.composite_keys}"))
    if found.most_rows > SIZES[wanted.size]:
        out.append(Unmet("raw-size-exceeded", "raw_tables", f"{found.most_rows} rows exceed {wanted.size}"))
    return tuple(out)


def fits_keys(found: Features, mode: str) -> bool:
    return mode == "auto" or found.composite_key == (mode == "required")


def shown(found: Features, wanted: Request) -> set[tuple[str, str]]:
    """The parts of a request that a scenario shows."""
    out = {("staging", x) for x in wanted.staging if x in found.staging}
    out |= {("intermediate", x) for x in wanted.intermediate if x in found.intermediate}
    out |= {("metrics", x) for x in wanted.metrics if x in found.metrics}
    if wanted.joins != "auto" and found.joins == _JOIN_SETS[wanted.joins]:
        out.add(("joins", wanted.joins))
    if wanted.composite_keys != "auto" and fits_keys(found, wanted.composite_keys):
        out.add(("composite_keys", wanted.composite_keys))
    if found.most_rows <= SIZES[wanted.size]:
        out.add(("size", wanted.size))
    return out


def example_pair(known: list[Features], wanted: Request) -> tuple[str, str]:
    """The two scenarios that together show most of a request; then those that share least, the same domain, and names."""
    if len(known) < 2:
        raise ValueError("two scenarios are needed")

    def rank(pair: tuple[Features, Features]) -> tuple:
        a, b = (shown(x, wanted) for x in pair)
        return (-len(a | b), len(a & b), -sum(x.domain == wanted.domain for x in pair), tuple(x.scenario_id for x in pair))

    best = min(combinations(sorted(known, key=lambda x: x.scenario_id), 2), key=rank)
    return best[0].scenario_id, best[1].scenario_id
