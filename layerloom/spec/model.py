"""The objects of a scenario: raw tables, relationships, staging, intermediate and output models, assertions."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

from layerloom.spec.shapes import AnyScalar, Choice, Day, Flag, Instant, Integer, Many, Object, Real, Record, Text, TextMap, Variants, may, need, shaped, tag
from layerloom.types import DATE, NAMES, TIMESTAMP, Scalar

NAME = Text(1, 63, "[a-z][a-z0-9_]*")
LABEL = Text(1, 500)
NAMES_ = Many(NAME, 1, None, True)
SHARE = Real(0.0, 1.0)
TYPE = Choice(NAMES)
PLACEHOLDER = re.compile(r"\{([a-z][a-z0-9_]*)\}")


def _repeated(names: Iterator[str] | list[str]) -> bool:
    names = list(names)
    return len(names) != len(set(names))


# Expressions and conditions.

EXPRESSION, CONDITION = Variants("kind"), Variants("kind")


@shaped
class ColumnRef(Record):
    kind: str = tag("column")
    column: str = need(NAME)


@shaped
class Literal(Record):
    kind: str = tag("literal")
    value: Scalar = need(AnyScalar())


@shaped
class Binary(Record):
    kind: str = tag("binary")
    operator: str = need(Choice(("add", "subtract", "multiply", "divide")))
    left: Expression = need(EXPRESSION)
    right: Expression = need(EXPRESSION)


@shaped
class DatePart(Record):
    kind: str = tag("date_part")
    part: str = need(Choice(("year", "quarter", "month", "day", "day_of_week")))
    value: Expression = need(EXPRESSION)


@shaped
class Coalesce(Record):
    kind: str = tag("coalesce")
    values: tuple[Expression, ...] = need(Many(EXPRESSION, 2))


Expression = ColumnRef | Literal | Binary | DatePart | Coalesce
EXPRESSION.add(ColumnRef, Literal, Binary, DatePart, Coalesce)


@shaped
class Comparison(Record):
    kind: str = tag("comparison")
    operator: str = need(Choice(("eq", "ne", "lt", "lte", "gt", "gte")))
    left: Expression = need(EXPRESSION)
    right: Expression = need(EXPRESSION)


@shaped
class In(Record):
    kind: str = tag("in")
    value: Expression = need(EXPRESSION)
    options: tuple[Scalar, ...] = need(Many(AnyScalar(), 1))
    negated: bool = may(Flag(), False)


@shaped
class IsNull(Record):
    kind: str = tag("is_null")
    value: Expression = need(EXPRESSION)
    negated: bool = may(Flag(), False)


@shaped
class All(Record):
    kind: str = tag("all")
    conditions: tuple[Condition, ...] = need(Many(CONDITION, 2))


@shaped
class AnyOf(Record):
    kind: str = tag("any")
    conditions: tuple[Condition, ...] = need(Many(CONDITION, 2))


@shaped
class Not(Record):
    kind: str = tag("not")
    condition: Condition = need(CONDITION)


Condition = Comparison | In | IsNull | All | AnyOf | Not
CONDITION.add(Comparison, In, IsNull, All, AnyOf, Not)


# Raw tables and their generators.


class _Range(Record):
    def rules(self) -> Iterator[str]:
        if self.min >= self.max:
            yield "min must be below max"


@shaped
class FormattedId(Record):
    kind: str = tag("formatted_id")
    prefix: str = may(Text(0, 32, "[!-~]*"), "")
    digits: int = need(Integer(1, 18))
    start: int = may(Integer(0), 1)


@shaped
class IntegerRange(_Range):
    kind: str = tag("integer_range")
    min: int = need(Integer())
    max: int = need(Integer())


@shaped
class FloatRange(_Range):
    kind: str = tag("float_range")
    min: float = need(Real())
    max: float = need(Real())
    decimal_places: int = may(Integer(0, 12), 2)


@shaped
class DateRange(_Range):
    kind: str = tag("date_range")
    min: dt.date = need(Day())
    max: dt.date = need(Day())


@shaped
class TimestampRange(_Range):
    kind: str = tag("timestamp_range")
    min: dt.datetime = need(Instant())
    max: dt.datetime = need(Instant())


@shaped
class Categorical(Record):
    kind: str = tag("categorical")
    values: tuple[Scalar, ...] = need(Many(AnyScalar(), 1, None, True))
    weights: tuple[float, ...] | None = may(Many(Real(0.0), 1))

    def rules(self) -> Iterator[str]:
        if self.weights is not None:
            if len(self.weights) != len(self.values):
                yield "weights must be as many as values"
            if not any(self.weights):
                yield "a weight must be above 0"


@shaped
class BooleanDraw(Record):
    kind: str = tag("boolean")
    true_probability: float = may(SHARE, 0.5)


@shaped
class RandomString(Record):
    kind: str = tag("random_string")
    min_length: int = need(Integer(1))
    max_length: int = need(Integer(1))
    alphabet: str = may(Text(1), "abcdefghijklmnopqrstuvwxyz0123456789")

    def rules(self) -> Iterator[str]:
        if self.min_length > self.max_length:
            yield "min_length must not exceed max_length"
        if _repeated(list(self.alphabet)):
            yield "characters of the alphabet must be distinct"


@shaped
class Template(Record):
    kind: str = tag("template_string")
    template: str = need(Text(1, 256))

    def rules(self) -> Iterator[str]:
        if not self.parts:
            yield "a template needs a placeholder {column}"
        if re.search(r"[{}]", PLACEHOLDER.sub("", self.template)):
            yield "a brace belongs to no placeholder"

    @property
    def parts(self) -> tuple[str, ...]:
        """The columns that the template names, in order."""
        return tuple(PLACEHOLDER.findall(self.template))


@shaped
class ForeignKey(Record):
    kind: str = tag("foreign_key")
    relationship: str = need(NAME)
    target_side: str = need(Choice(("left", "right")))


class _Plausible(Record):
    """Plausible German data."""


_LOCALE = Choice(("de_DE",))


@shaped
class PersonName(_Plausible):
    kind: str = tag("person_name")
    locale: str = may(_LOCALE, "de_DE")


@shaped
class Email(_Plausible):
    kind: str = tag("email")
    locale: str = may(_LOCALE, "de_DE")


@shaped
class City(_Plausible):
    kind: str = tag("city")
    locale: str = may(_LOCALE, "de_DE")


@shaped
class StreetAddress(_Plausible):
    kind: str = tag("street_address")
    locale: str = may(_LOCALE, "de_DE")


@shaped
class CompanyName(_Plausible):
    kind: str = tag("company_name")
    locale: str = may(_LOCALE, "de_DE")


@shaped
class PhoneNumber(_Plausible):
    kind: str = tag("phone_number")
    locale: str = may(_LOCALE, "de_DE")


PLAUSIBLE = (PersonName, Email, City, StreetAddress, CompanyName, PhoneNumber)
GENERATOR = Variants("kind").add(FormattedId, IntegerRange, FloatRange, DateRange, TimestampRange, Categorical, BooleanDraw, RandomString, Template, ForeignKey, *PLAUSIBLE)


@shaped
class RowCount(Record):
    min: int = need(Integer(1))
    max: int = need(Integer(1))

    def rules(self) -> Iterator[str]:
        if self.max < self.min:
            yield "max must not be below min"


@shaped
class RawColumn(Record):
    name: str = need(NAME)
    type: str = need(TYPE)
    nullable: bool = may(Flag(), False)
    null_probability: float = may(SHARE, 0.0)
    unique: bool = may(Flag(), False)
    generator: Record = need(GENERATOR)
    description: str | None = may(LABEL)

    def rules(self) -> Iterator[str]:
        if not self.nullable and self.null_probability:
            yield "a column that isn't nullable has null_probability 0.0"


@shaped
class RawTable(Record):
    name: str = need(NAME)
    rows: RowCount = need(Object(RowCount))
    columns: tuple[RawColumn, ...] = need(Many(Object(RawColumn), 1))
    primary_key: tuple[str, ...] = may(Many(NAME, 0, None, True), ())
    description: str | None = may(LABEL)

    def rules(self) -> Iterator[str]:
        if _repeated(c.name for c in self.columns):
            yield "columns must have distinct names"


# Relationships.


@shaped
class Endpoint(Record):
    table: str = need(NAME)
    columns: tuple[str, ...] = need(NAMES_)


@shaped
class Bridge(Record):
    table: str = need(NAME)
    left_columns: tuple[str, ...] = need(NAMES_)
    right_columns: tuple[str, ...] = need(NAMES_)

    def rules(self) -> Iterator[str]:
        if set(self.left_columns) & set(self.right_columns):
            yield "left_columns and right_columns must be disjoint"


class Relationship(Record):
    """A declared link between two raw tables, read from left to right."""

    name: str
    cardinality: str
    left: Endpoint
    right: Endpoint


@shaped
class OneToOne(Relationship):
    name: str = need(NAME)
    cardinality: str = tag("one_to_one")
    left: Endpoint = need(Object(Endpoint))
    right: Endpoint = need(Object(Endpoint))
    description: str | None = may(LABEL)


@shaped
class OneToMany(Relationship):
    name: str = need(NAME)
    cardinality: str = tag("one_to_many")
    left: Endpoint = need(Object(Endpoint))
    right: Endpoint = need(Object(Endpoint))
    description: str | None = may(LABEL)


@shaped
class ManyToOne(Relationship):
    name: str = need(NAME)
    cardinality: str = tag("many_to_one")
    left: Endpoint = need(Object(Endpoint))
    right: Endpoint = need(Object(Endpoint))
    description: str | None = may(LABEL)


@shaped
class ManyToMany(Relationship):
    name: str = need(NAME)
    cardinality: str = tag("many_to_many")
    left: Endpoint = need(Object(Endpoint))
    right: Endpoint = need(Object(Endpoint))
    bridge: Bridge = need(Object(Bridge))
    description: str | None = may(LABEL)


# Staging.


@shaped
class SortKey(Record):
    column: str = need(NAME)
    direction: str = may(Choice(("asc", "desc")), "asc")


SORT = Many(Object(SortKey), 1)


@shaped
class Cast(Record):
    op: str = tag("cast")
    type: str = need(TYPE)
    format: str | None = may(Text(1))

    def rules(self) -> Iterator[str]:
        if self.format is not None and self.type not in (DATE, TIMESTAMP):
            yield "format goes with a date or timestamp only"


@shaped
class Trim(Record):
    op: str = tag("trim")


@shaped
class Lower(Record):
    op: str = tag("lower")


@shaped
class Upper(Record):
    op: str = tag("upper")


@shaped
class Replace(Record):
    op: str = tag("replace")
    old: str = need(Text(1))
    new: str = need(Text())


@shaped
class MapValues(Record):
    op: str = tag("map_values")
    mapping: tuple[tuple[str, str], ...] = need(TextMap())
    on_unmapped: str = may(Choice(("keep", "null", "error")), "keep")


@shaped
class NullIf(Record):
    op: str = tag("null_if")
    values: tuple[Scalar, ...] = need(Many(AnyScalar(), 1))


@shaped
class FillNull(Record):
    op: str = tag("coalesce")
    value: Scalar = need(AnyScalar())


ColumnOperation = Cast | Trim | Lower | Upper | Replace | MapValues | NullIf | FillNull
COLUMN_OPERATION = Variants("op").add(Cast, Trim, Lower, Upper, Replace, MapValues, NullIf, FillNull)


@shaped
class FilterRows(Record):
    op: str = tag("filter")
    condition: Condition = need(CONDITION)


@shaped
class DeduplicateRows(Record):
    op: str = tag("deduplicate")
    keys: tuple[str, ...] = need(NAMES_)
    order_by: tuple[SortKey, ...] = need(SORT)


RowOperation = FilterRows | DeduplicateRows


@shaped
class StagingColumn(Record):
    source: str = need(NAME)
    target: str = need(NAME)
    operations: tuple[ColumnOperation, ...] = may(Many(COLUMN_OPERATION), ())
    description: str | None = may(LABEL)


@shaped
class StagingModel(Record):
    name: str = need(NAME)
    source: str = need(NAME)
    columns: tuple[StagingColumn, ...] = need(Many(Object(StagingColumn), 1))
    row_operations: tuple[RowOperation, ...] = may(Many(Variants("op").add(FilterRows, DeduplicateRows)), ())
    grain: tuple[str, ...] = need(NAMES_)
    description: str | None = may(LABEL)

    def rules(self) -> Iterator[str]:
        if _repeated(c.source for c in self.columns):
            yield "a source column may be taken once"
        if _repeated(c.target for c in self.columns):
            yield "target columns must have distinct names"


# Intermediate and output models.


@shaped
class Projection(Record):
    source: str = need(NAME)
    target: str = need(NAME)


@shaped
class SideProjection(Record):
    side: str = need(Choice(("left", "right")))
    source: str = need(NAME)
    target: str = need(NAME)


@shaped
class Derived(Record):
    name: str = need(NAME)
    type: str = need(TYPE)
    expression: Expression = need(EXPRESSION)
    description: str | None = may(LABEL)


@shaped
class KeyPair(Record):
    left: str = need(NAME)
    right: str = need(NAME)


@shaped
class Join(Record):
    type: str = need(Choice(("inner", "left")))
    on: tuple[KeyPair, ...] = need(Many(Object(KeyPair), 1, None, True))


class Metric(Record):
    """An aggregate of a group."""

    name: str
    function: str


@shaped
class CountRows(Metric):
    name: str = need(NAME)
    function: str = tag("count_rows")
    description: str | None = may(LABEL)


@shaped
class Count(Metric):
    name: str = need(NAME)
    function: str = tag("count")
    column: str = need(NAME)
    description: str | None = may(LABEL)


@shaped
class CountDistinct(Metric):
    name: str = need(NAME)
    function: str = tag("count_distinct")
    column: str = need(NAME)
    description: str | None = may(LABEL)


@shaped
class Sum(Metric):
    name: str = need(NAME)
    function: str = tag("sum")
    column: str = need(NAME)
    description: str | None = may(LABEL)


@shaped
class Average(Metric):
    name: str = need(NAME)
    function: str = tag("avg")
    column: str = need(NAME)
    description: str | None = may(LABEL)


@shaped
class Minimum(Metric):
    name: str = need(NAME)
    function: str = tag("min")
    column: str = need(NAME)
    description: str | None = may(LABEL)


@shaped
class Maximum(Metric):
    name: str = need(NAME)
    function: str = tag("max")
    column: str = need(NAME)
    description: str | None = may(LABEL)


@shaped
class ConditionalCount(Metric):
    name: str = need(NAME)
    function: str = tag("conditional_count")
    condition: Condition = need(CONDITION)
    description: str | None = may(LABEL)


@shaped
class ConditionalSum(Metric):
    name: str = need(NAME)
    function: str = tag("conditional_sum")
    column: str = need(NAME)
    condition: Condition = need(CONDITION)
    description: str | None = may(LABEL)


METRICS = Many(Variants("function").add(CountRows, Count, CountDistinct, Sum, Average, Minimum, Maximum, ConditionalCount, ConditionalSum), 1)


class _Selecting(Record):
    def rules(self) -> Iterator[str]:
        if _repeated([c.target for c in self.columns] + [d.name for d in self.derived_columns]):
            yield "projected and derived columns must have distinct names"


class _Grouping(Record):
    def rules(self) -> Iterator[str]:
        if _repeated(c.source for c in self.group_by):
            yield "a column may be grouped by once"
        if _repeated([c.target for c in self.group_by] + [m.name for m in self.metrics]):
            yield "group columns and metrics must have distinct names"


@shaped
class Transform(_Selecting):
    operation: str = tag("transform")
    name: str = need(NAME)
    source: str = need(NAME)
    columns: tuple[Projection, ...] = need(Many(Object(Projection), 1))
    derived_columns: tuple[Derived, ...] = may(Many(Object(Derived)), ())
    filters: tuple[Condition, ...] = may(Many(CONDITION), ())
    grain: tuple[str, ...] = need(NAMES_)
    description: str | None = may(LABEL)


@shaped
class JoinModel(_Selecting):
    operation: str = tag("join")
    name: str = need(NAME)
    left: str = need(NAME)
    right: str = need(NAME)
    join: Join = need(Object(Join))
    columns: tuple[SideProjection, ...] = need(Many(Object(SideProjection), 1))
    derived_columns: tuple[Derived, ...] = may(Many(Object(Derived)), ())
    filters: tuple[Condition, ...] = may(Many(CONDITION), ())
    grain: tuple[str, ...] = need(NAMES_)
    description: str | None = may(LABEL)


@shaped
class Aggregate(_Grouping):
    operation: str = tag("aggregate")
    name: str = need(NAME)
    source: str = need(NAME)
    filters: tuple[Condition, ...] = may(Many(CONDITION), ())
    group_by: tuple[Projection, ...] = need(Many(Object(Projection), 1))
    metrics: tuple[Metric, ...] = need(METRICS)
    grain: tuple[str, ...] = need(NAMES_)
    description: str | None = may(LABEL)


@shaped
class Deduplicate(Record):
    operation: str = tag("deduplicate")
    name: str = need(NAME)
    source: str = need(NAME)
    keys: tuple[str, ...] = need(NAMES_)
    order_by: tuple[SortKey, ...] = need(SORT)
    grain: tuple[str, ...] = need(NAMES_)
    description: str | None = may(LABEL)

    def rules(self) -> Iterator[str]:
        if set(self.grain) != set(self.keys):
            yield "grain must name the keys"


Intermediate = Transform | JoinModel | Aggregate | Deduplicate


@shaped
class OutputModel(_Grouping):
    name: str = need(NAME)
    source: str = need(NAME)
    filters: tuple[Condition, ...] = may(Many(CONDITION), ())
    group_by: tuple[Projection, ...] = need(Many(Object(Projection), 1))
    grain: tuple[str, ...] = need(NAMES_)
    dimensions: tuple[str, ...] = may(Many(NAME, 0, None, True), ())
    metrics: tuple[Metric, ...] = need(METRICS)
    description: str | None = may(LABEL)


# Assertions.


class Assertion(Record):
    """A condition that a built table must meet."""

    name: str
    model: str
    type: str


@shaped
class NotNull(Assertion):
    name: str = need(NAME)
    model: str = need(NAME)
    type: str = tag("not_null")
    columns: tuple[str, ...] = need(NAMES_)
    description: str | None = may(LABEL)


@shaped
class Unique(Assertion):
    name: str = need(NAME)
    model: str = need(NAME)
    type: str = tag("unique")
    columns: tuple[str, ...] = need(NAMES_)
    description: str | None = may(LABEL)


@shaped
class AcceptedValues(Assertion):
    name: str = need(NAME)
    model: str = need(NAME)
    type: str = tag("accepted_values")
    column: str = need(NAME)
    values: tuple[Scalar, ...] = need(Many(AnyScalar(), 1, None, True))
    description: str | None = may(LABEL)


@shaped
class References(Assertion):
    name: str = need(NAME)
    model: str = need(NAME)
    type: str = tag("relationships")
    columns: tuple[str, ...] = need(Many(NAME, 1))
    to_model: str = need(NAME)
    to_columns: tuple[str, ...] = need(Many(NAME, 1))
    description: str | None = may(LABEL)

    def rules(self) -> Iterator[str]:
        if len(self.columns) != len(self.to_columns):
            yield "columns and to_columns must be as many"


@shaped
class RowsBetween(Assertion):
    name: str = need(NAME)
    model: str = need(NAME)
    type: str = tag("row_count")
    min: int | None = may(Integer(0))
    max: int | None = may(Integer(0))
    description: str | None = may(LABEL)

    def rules(self) -> Iterator[str]:
        if self.min is None and self.max is None:
            yield "a bound is needed"
        elif self.min is not None and self.max is not None and self.min > self.max:
            yield "min must not exceed max"


@shaped
class ColumnRange(Assertion):
    name: str = need(NAME)
    model: str = need(NAME)
    type: str = tag("column_range")
    column: str = need(NAME)
    min: Scalar | None = may(AnyScalar())
    max: Scalar | None = may(AnyScalar())
    inclusive: bool = may(Flag(), True)
    description: str | None = may(LABEL)

    def rules(self) -> Iterator[str]:
        if self.min is None and self.max is None:
            yield "a bound is needed"


@shaped
class Scenario(Record):
    """A pipeline of four layers over raw tables."""

    schema_version: str = need(Choice(("1.0",)))
    scenario_id: str = need(Text(1, 100, "[a-z][a-z0-9_]*"))
    domain: str = need(NAME)
    description: str | None = may(LABEL)
    raw_tables: tuple[RawTable, ...] = need(Many(Object(RawTable), 3, 4))
    relationships: tuple[Relationship, ...] = need(Many(Variants("cardinality").add(OneToOne, OneToMany, ManyToOne, ManyToMany), 1))
    staging_models: tuple[StagingModel, ...] = need(Many(Object(StagingModel), 3, 4))
    intermediate_models: tuple[Intermediate, ...] = need(Many(Variants("operation").add(Transform, JoinModel, Aggregate, Deduplicate), 2, 3))
    output_models: tuple[OutputModel, ...] = need(Many(Object(OutputModel), 1, 2))
    tests: tuple[Assertion, ...] = may(Many(Variants("type").add(NotNull, Unique, AcceptedValues, References, RowsBetween, ColumnRange)), ())
