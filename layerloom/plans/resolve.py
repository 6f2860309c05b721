"""Semantic analysis: every reference, type, key and proof of a scenario, with all independent defects in one pass."""

from __future__ import annotations

from collections import Counter
from graphlib import CycleError, TopologicalSorter

from layerloom.errors import Issue, SemanticError
from layerloom.functions.cleaning import chain_type
from layerloom.functions.expressions import TypeMismatch, UnknownColumn, check_condition, columns_of, type_of
from layerloom.functions.metrics import metric_type
from layerloom.plans.join_rules import check_grain, followed_link
from layerloom.plans.raw_rules import check_tables, links_of
from layerloom.plans.resolved import Lineage, Link, ResolvedPlan, meaning, reads
from layerloom.spec import model as m
from layerloom.types import NUMERIC, Schema, scalar_type


class _Analysis:
    def __init__(self, scenario: m.Scenario):
        self.s = scenario
        self.issues: list[Issue] = []
        self.schemas: dict[str, Schema] = {}
        self.lineage: dict[str, Lineage] = {}
        self.grains: dict[str, tuple[str, ...]] = {}
        self.broken: set[str] = set()  # models whose schema isn't known; what reads them is not judged
        self.links: tuple[Link, ...] = ()

    def report(self, code: str, path: str, message: str) -> None:
        self.issues.append(Issue(path, code, message))

    # Names.

    def names(self) -> None:
        s = self.s
        models = [x.name for x in (*s.staging_models, *s.intermediate_models, *s.output_models)]
        tables = [t.name for t in s.raw_tables]
        for code, kind, names in (("E100", "raw_tables", tables), ("E101", "models", models), ("E103", "relationships", [r.name for r in s.relationships]), ("E104", "tests", [t.name for t in s.tests])):
            for name, n in Counter(names).items():
                if n > 1:
                    self.report(code, f"{kind}[{name}]", "the name is taken twice")
        for name in set(tables) & set(models):
            self.report("E102", f"models[{name}]", "a raw table has this name")

    # Typed pieces: each reports at most one issue and tells whether it went well.

    def try_type(self, node: m.Expression, schema: Schema, at: str) -> str | None:
        try:
            return type_of(node, schema)
        except UnknownColumn as e:
            self.report("E105", at, f"no column {e.args[0]}")
        except TypeMismatch as e:
            self.report(e.code, at, str(e))
        return None

    def try_conditions(self, conditions: tuple[m.Condition, ...], schema: Schema, at: str) -> None:
        for i, c in enumerate(conditions):
            try:
                check_condition(c, schema)
            except UnknownColumn as e:
                self.report("E105", f"{at}[{i}]", f"no column {e.args[0]}")
            except TypeMismatch as e:
                self.report(e.code, f"{at}[{i}]", str(e))

    def named(self, columns: tuple[str, ...], schema: Schema, at: str, code: str = "E105") -> bool:
        missing = [c for c in columns if c not in schema]
        for c in missing:
            self.report(code, at, f"no column {c}")
        return not missing

    def settle(self, name: str, schema: Schema, lineage: Lineage, grain: tuple[str, ...]) -> None:
        self.schemas[name], self.lineage[name], self.grains[name] = schema, lineage, grain

    # Layers.

    def raw(self) -> None:
        check_tables(self.s, self.report)
        self.links = links_of(self.s, self.report)
        for t in self.s.raw_tables:
            self.settle(t.name, {c.name: c.type for c in t.columns}, {c.name: frozenset({(t.name, c.name)}) for c in t.columns}, t.primary_key)

    def staging(self) -> None:
        raw = {t.name: t for t in self.s.raw_tables}
        taken = Counter(x.source for x in self.s.staging_models)
        for t in self.s.raw_tables:
            if taken[t.name] != 1:
                self.report("E118", f"raw_tables[{t.name}]", f"read by {taken[t.name]} staging models, not one")
        for model in self.s.staging_models:
            at = f"staging_models[{model.name}]"
            if model.source not in raw:
                self.report("E118" if model.source in {x.name for x in (*self.s.intermediate_models, *self.s.staging_models)} else "E105", f"{at}.source", f"no raw table {model.source}")
                self.broken.add(model.name)
                continue
            schema: Schema = {}
            for c in model.columns:
                if c.source not in self.schemas[model.source]:
                    self.report("E119", f"{at}.columns[{c.target}]", f"{model.source} has no column {c.source}")
                    self.broken.add(model.name)
                    continue
                try:
                    schema[c.target] = chain_type(self.schemas[model.source][c.source], c.operations)
                except TypeMismatch as e:
                    self.report(e.code, f"{at}.columns[{c.target}].operations", str(e))
                    self.broken.add(model.name)
            self.settle(model.name, schema, {c.target: frozenset({(model.source, c.source)}) for c in model.columns}, model.grain)
            if model.name in self.broken:
                continue
            for i, op in enumerate(model.row_operations):
                here = f"{at}.row_operations[{i}]"
                if isinstance(op, m.FilterRows):
                    self.try_conditions((op.condition,), schema, here)
                elif self.named((*op.keys, *(k.column for k in op.order_by)), schema, here):
                    self.ties(op, model.name, None, here)
            self.named(model.grain, schema, f"{at}.grain", "E121")

    def ties(self, op: m.DeduplicateRows | m.Deduplicate, model: str, source_grain: tuple[str, ...] | None, at: str) -> None:
        """Which row is first must be certain: keys and order together hold something unique."""
        used = {*op.keys, *(k.column for k in op.order_by)}
        origins = {o for c in used if len(self.lineage[model].get(c, ())) == 1 for o in self.lineage[model][c]}
        unique = [{(t.name, c) for c in t.primary_key} for t in self.s.raw_tables if t.primary_key]
        unique += [{(t.name, c.name)} for t in self.s.raw_tables for c in t.columns if c.unique]
        if not (source_grain and set(source_grain) <= used) and not any(u <= origins for u in unique):
            self.report("E134", at, "keys and order hold nothing unique, so the first row isn't certain")

    def order(self) -> tuple[str, ...]:
        """Intermediate models after what they read; ties in the order of declaration."""
        s = self.s
        inner = {x.name: x for x in s.intermediate_models}
        staged, outputs, tables = {x.name for x in s.staging_models}, {x.name for x in s.output_models}, {t.name for t in s.raw_tables}
        for name, model in inner.items():
            for source in reads(model):
                at = f"intermediate_models[{name}]"
                if source in tables or source in outputs:
                    self.report("E123", at, f"{source} is not in a layer that it may read")
                elif source not in staged and source not in inner:
                    self.report("E105", at, f"no model {source}")
                else:
                    continue
                self.broken.add(name)
        graph = {name: [x for x in reads(model) if x in inner] for name, model in inner.items()}
        sorter, done = TopologicalSorter(graph), []
        try:
            sorter.prepare()
        except CycleError as e:
            self.report("E122", f"intermediate_models[{e.args[1][0]}]", f"models need each other: {' -> '.join(e.args[1])}")
            self.broken |= set(inner)
            return tuple(inner)
        while sorter.is_active():
            ready = sorted(sorter.get_ready(), key=list(inner).index)
            done += ready
            sorter.done(*ready)
        return tuple(done)

    def select(self, model: m.Transform | m.JoinModel, inputs: dict[str, str], at: str) -> None:
        """Projection, derived columns over projected names, filters over both."""
        schema: Schema = {}
        lineage: Lineage = {}
        for c in model.columns:
            source = inputs[getattr(c, "side", "")]
            if c.source not in self.schemas[source]:
                self.report("E105", f"{at}.columns[{c.target}]", f"{source} has no column {c.source}")
                self.broken.add(model.name)
            else:
                schema[c.target], lineage[c.target] = self.schemas[source][c.source], self.lineage[source].get(c.source, frozenset())
        out, found = dict(schema), dict(lineage)
        for d in model.derived_columns:
            here = f"{at}.derived_columns[{d.name}]"
            if model.name in self.broken:
                break
            kind = self.try_type(d.expression, schema, here)
            if kind is not None and kind != d.type:
                self.report("E129", here, f"is declared {d.type} but is {kind}")
            out[d.name] = d.type
            found[d.name] = frozenset().union(*(lineage.get(c, frozenset()) for c in columns_of(d.expression)))
        self.settle(model.name, out, found, model.grain)
        if model.name not in self.broken:
            self.try_conditions(model.filters, out, f"{at}.filters")
            self.named(model.grain, out, f"{at}.grain", "E125")

    def grouped(self, model: m.Aggregate | m.OutputModel, at: str) -> None:
        schema, lineage = self.schemas[model.source], self.lineage[model.source]
        self.try_conditions(model.filters, schema, f"{at}.filters")
        out: Schema = {}
        found: Lineage = {}
        for c in model.group_by:
            if self.named((c.source,), schema, f"{at}.group_by[{c.target}]"):
                out[c.target], found[c.target] = schema[c.source], lineage.get(c.source, frozenset())
            else:
                self.broken.add(model.name)
        for x in model.metrics:
            here = f"{at}.metrics[{x.name}]"
            try:
                out[x.name] = metric_type(x, schema)
            except UnknownColumn as e:
                self.report("E126", here, f"no column {e.args[0]}")
                self.broken.add(model.name)
            except TypeMismatch as e:
                self.report(e.code, here, str(e))
                self.broken.add(model.name)
            used = {getattr(x, "column", None)} - {None} | (columns_of(x.condition) if hasattr(x, "condition") else set())
            found[x.name] = frozenset().union(*(lineage.get(c, frozenset()) for c in used))
        targets = {c.target for c in model.group_by}
        for what in ("grain", "dimensions"):
            for c in getattr(model, what, ()):
                if c not in targets:
                    self.report("E125", f"{at}.{what}", f"{c} is no group column")
        self.settle(model.name, out, found, model.grain)

    def intermediate(self, order: tuple[str, ...]) -> None:
        inner = {x.name: x for x in self.s.intermediate_models}
        for name in order:
            model, at = inner[name], f"intermediate_models[{name}]"
            if name in self.broken or any(x in self.broken for x in reads(model)):
                self.broken.add(name)
                continue
            match model:
                case m.Transform():
                    self.select(model, {"": model.source}, at)
                case m.JoinModel():
                    self.join(model, at)
                case m.Aggregate():
                    self.grouped(model, at)
                case m.Deduplicate():
                    schema = self.schemas[model.source]
                    self.settle(name, dict(schema), dict(self.lineage[model.source]), model.grain)
                    self.named(model.grain, schema, f"{at}.grain", "E125")
                    if self.named(tuple(k.column for k in model.order_by), schema, f"{at}.order_by"):
                        self.ties(model, model.source, self.grains[model.source], at)

    def join(self, model: m.JoinModel, at: str) -> None:
        self.select(model, {"left": model.left, "right": model.right}, at)
        sides = {"left": model.left, "right": model.right}
        fine = True
        for k in model.join.on:
            kinds = {}
            for side, source in sides.items():
                if getattr(k, side) not in self.schemas[source]:
                    self.report("E124", f"{at}.join.on", f"{source} has no column {getattr(k, side)}")
                    fine = False
                else:
                    kinds[side] = self.schemas[source][getattr(k, side)]
            if len(set(kinds.values())) > 1:
                self.report("E124", f"{at}.join.on", f"{k.left} is {kinds['left']}, {k.right} is {kinds['right']}")
                fine = False
        if fine and (found := followed_link(model, self.lineage[model.left], self.lineage[model.right], self.links, at, self.report)) and model.name not in self.broken:
            check_grain(model, self.grains, *found, at, self.report)

    def outputs(self) -> None:
        inner = {x.name for x in self.s.intermediate_models}
        known = inner | {x.name for x in (*self.s.staging_models, *self.s.output_models)} | {t.name for t in self.s.raw_tables}
        for model in self.s.output_models:
            at = f"output_models[{model.name}]"
            if model.source not in inner:
                self.report("E123" if model.source in known else "E105", f"{at}.source", f"{model.source} is no intermediate model")
                self.broken.add(model.name)
            elif model.source in self.broken:
                self.broken.add(model.name)
            else:
                self.grouped(model, at)

    # The whole.

    def connected(self) -> None:
        """Every model and raw table leads to an output."""
        sources = {x.name: reads(x) for x in (*self.s.staging_models, *self.s.intermediate_models, *self.s.output_models)}
        used, todo = set(), [x.name for x in self.s.output_models]
        while todo:
            name = todo.pop()
            if name not in used:
                used.add(name)
                todo += sources.get(name, ())
        for kind in ("staging_models", "intermediate_models"):
            for x in getattr(self.s, kind):
                if x.name not in used:
                    self.report("E127", f"{kind}[{x.name}]", "leads to no output")
        for t in self.s.raw_tables:
            if t.name not in used and any(x.source == t.name for x in self.s.staging_models):
                self.report("E127", f"raw_tables[{t.name}]", "leads to no output")

    def tests(self, derived: tuple[m.Assertion, ...]) -> None:
        known, said = set(map(meaning, derived)), {}
        must_have_rows = {a.model for a in derived if isinstance(a, m.RowsBetween)}
        for a in self.s.tests:
            at = f"tests[{a.name}]"
            if a.model not in self.schemas:
                if a.model not in self.broken:
                    self.report("E105", f"{at}.model", f"no table or model {a.model}")
                continue
            schema = self.schemas[a.model]
            columns = getattr(a, "columns", (a.column,) if hasattr(a, "column") else ())
            if a.model in self.broken or not self.named(columns, schema, at):
                continue
            match a:
                case m.AcceptedValues():
                    if any(scalar_type(v) != schema[a.column] for v in a.values):
                        self.report("E108", f"{at}.values", f"values must all be of type {schema[a.column]}")
                case m.ColumnRange():
                    for bound in ("min", "max"):
                        value = getattr(a, bound)
                        if value is not None and (scalar_type(value) != schema[a.column] or schema[a.column] not in NUMERIC):
                            self.report("E999", f"{at}.{bound}", f"{value!r} bounds no {schema[a.column]}")
                case m.References():
                    if a.to_model not in self.schemas:
                        self.report("E105", f"{at}.to_model", f"no table or model {a.to_model}")
                    elif self.named(a.to_columns, self.schemas[a.to_model], at):
                        for x, y in zip(a.columns, a.to_columns, strict=True):
                            if schema[x] != self.schemas[a.to_model][y]:
                                self.report("E114", at, f"{x} is {schema[x]}, {y} is {self.schemas[a.to_model][y]}")
                case m.RowsBetween():
                    if a.max == 0 and a.model in must_have_rows:
                        self.report("E128", at, "an output has at least one row")
            if (key := meaning(a)) in said:
                self.report("E128", at, f"says the same as {said[key]}")
            elif key in known:
                self.report("E128", at, "says what follows from the declarations")
            said.setdefault(key, a.name)

    def derive(self) -> tuple[m.Assertion, ...]:
        """What keys, nullability, grains and relationships imply."""
        out: list[m.Assertion] = []

        def key(model: str, columns: tuple[str, ...]) -> None:
            out.append(m.Unique(name=f"derived_unique_{model}", model=model, columns=columns))
            out.extend(m.NotNull(name=f"derived_not_null_{model}_{c}", model=model, columns=(c,)) for c in columns)

        for t in self.s.raw_tables:
            if t.primary_key:
                key(t.name, t.primary_key)
            for c in t.columns:
                if c.unique:
                    out.append(m.Unique(name=f"derived_unique_{t.name}_{c.name}", model=t.name, columns=(c.name,)))
                if not c.nullable and c.name not in t.primary_key:
                    out.append(m.NotNull(name=f"derived_not_null_{t.name}_{c.name}", model=t.name, columns=(c.name,)))
        for x in (*self.s.staging_models, *self.s.intermediate_models):
            key(x.name, x.grain)
        for k in self.links:
            side = f"_{k.side}" if k.cardinality == "many_to_many" else ""
            out.append(m.References(name=f"derived_rel_{k.relationship}{side}", model=k.child, columns=k.child_columns, to_model=k.parent, to_columns=k.parent_columns))
        out += [m.RowsBetween(name=f"derived_row_count_{x.name}", model=x.name, min=1) for x in self.s.output_models]
        return tuple(out)


def resolve(scenario: m.Scenario, output_grain: bool = True) -> ResolvedPlan:
    """The plan of a scenario; raises SemanticError with all issues. output_grain: outputs' grains are checked too."""
    a = _Analysis(scenario)
    a.names()
    a.raw()
    a.staging()
    order = a.order()
    a.intermediate(order)
    a.outputs()
    a.connected()
    derived = a.derive()
    a.tests(derived)
    if a.issues:
        raise SemanticError(a.issues)
    if output_grain:
        for x in scenario.output_models:
            derived += (m.Unique(name=f"derived_unique_{x.name}", model=x.name, columns=x.grain),)
            derived += tuple(m.NotNull(name=f"derived_not_null_{x.name}_{c}", model=x.name, columns=(c,)) for c in x.grain)
    everything = (*(x.name for x in scenario.staging_models), *order, *(x.name for x in scenario.output_models))
    return ResolvedPlan(scenario, a.schemas, a.lineage, a.links, everything, a.grains, derived)
