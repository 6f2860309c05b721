"""Strict readers of JSON values. Each shape reads a value or raises Problem, writes it back and describes itself.

An object's shape is a frozen dataclass whose fields carry shapes; `rules()` may yield what is wrong with the whole.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import math
import re
from collections.abc import Iterator
from typing import Any, dataclass_transform


class Problem(ValueError):
    def __init__(self, path: str, message: str):
        super().__init__(message)
        self.path, self.message = path, message


class Shape:
    def read(self, value: Any, path: str) -> Any:
        raise NotImplementedError

    def write(self, value: Any) -> Any:
        return value

    def describe(self, known: dict) -> dict:
        return {}


@dataclasses.dataclass(frozen=True)
class Text(Shape):
    least: int = 0
    most: int | None = None
    pattern: str | None = None

    def read(self, value: Any, path: str) -> str:
        if type(value) is not str:
            raise Problem(path, "must be a string")
        if len(value) < self.least or (self.most is not None and len(value) > self.most):
            raise Problem(path, f"length must be {self.least} to {self.most}")
        if self.pattern and not re.fullmatch(self.pattern, value):
            raise Problem(path, f"must match {self.pattern}")
        return value

    def describe(self, known: dict) -> dict:
        out = {"type": "string", "minLength": self.least, "maxLength": self.most, "pattern": self.pattern and f"^{self.pattern}$"}
        return {k: v for k, v in out.items() if v}


@dataclasses.dataclass(frozen=True)
class Integer(Shape):
    least: int | None = None
    most: int | None = None

    def read(self, value: Any, path: str) -> int:
        if type(value) is not int:
            raise Problem(path, "must be an integer")
        if (self.least is not None and value < self.least) or (self.most is not None and value > self.most):
            raise Problem(path, f"must be {self.least} to {self.most}")
        return value

    def describe(self, known: dict) -> dict:
        out = {"type": "integer", "minimum": self.least, "maximum": self.most}
        return {k: v for k, v in out.items() if v is not None}


@dataclasses.dataclass(frozen=True)
class Real(Shape):
    """A finite number written with a fraction or exponent; an integer isn't taken for one."""

    least: float | None = None
    most: float | None = None

    def read(self, value: Any, path: str) -> float:
        if type(value) is not float or not math.isfinite(value):
            raise Problem(path, "must be a finite number with a fraction")
        if (self.least is not None and value < self.least) or (self.most is not None and value > self.most):
            raise Problem(path, f"must be {self.least} to {self.most}")
        return value

    def describe(self, known: dict) -> dict:
        out = {"type": "number", "minimum": self.least, "maximum": self.most}
        return {k: v for k, v in out.items() if v is not None}


class Flag(Shape):
    def read(self, value: Any, path: str) -> bool:
        if type(value) is not bool:
            raise Problem(path, "must be true or false")
        return value

    def describe(self, known: dict) -> dict:
        return {"type": "boolean"}


class AnyScalar(Shape):
    def read(self, value: Any, path: str) -> Any:
        if type(value) not in (str, int, float, bool) or (type(value) is float and not math.isfinite(value)):
            raise Problem(path, "must be a string, a finite number or a boolean")
        return value

    def describe(self, known: dict) -> dict:
        return {"type": ["string", "integer", "number", "boolean"]}


@dataclasses.dataclass(frozen=True)
class Choice(Shape):
    options: tuple[str, ...]

    def read(self, value: Any, path: str) -> str:
        if type(value) is not str or value not in self.options:
            raise Problem(path, f"must be one of {', '.join(self.options)}")
        return value

    def describe(self, known: dict) -> dict:
        return {"enum": list(self.options)} if len(self.options) > 1 else {"const": self.options[0]}


class Day(Shape):
    def read(self, value: Any, path: str) -> dt.date:
        if type(value) is str and re.fullmatch(r"\d{4}-\d\d-\d\d", value):
            try:
                return dt.date.fromisoformat(value)
            except ValueError:
                pass
        raise Problem(path, "must be a date, YYYY-MM-DD")

    def write(self, value: dt.date) -> str:
        return value.isoformat()

    def describe(self, known: dict) -> dict:
        return {"type": "string", "format": "date"}


class Instant(Shape):
    """A timestamp with an offset, kept in UTC."""

    def read(self, value: Any, path: str) -> dt.datetime:
        try:
            found = dt.datetime.fromisoformat(value) if type(value) is str and "T" in value else None
            if found is not None and found.utcoffset() is not None:
                return found.astimezone(dt.UTC)
        except (ValueError, OverflowError):
            pass
        raise Problem(path, "must be a timestamp with an offset")

    def write(self, value: dt.datetime) -> str:
        return value.isoformat()

    def describe(self, known: dict) -> dict:
        return {"type": "string", "format": "date-time"}


@dataclasses.dataclass(frozen=True)
class Many(Shape):
    """A list, read as a tuple; distinct names what makes two items the same."""

    item: Shape
    least: int = 0
    most: int | None = None
    distinct: bool = False

    def read(self, value: Any, path: str) -> tuple:
        if type(value) is not list:
            raise Problem(path, "must be a list")
        if len(value) < self.least or (self.most is not None and len(value) > self.most):
            raise Problem(path, f"must have {self.least} to {self.most or 'any number of'} items")
        out = tuple(self.item.read(v, f"{path}.{i}") for i, v in enumerate(value))
        if self.distinct and len({(type(v), v) for v in out}) < len(out):
            raise Problem(path, "items must be distinct")
        return out

    def write(self, value: tuple) -> list:
        return [self.item.write(v) for v in value]

    def describe(self, known: dict) -> dict:
        out = {"type": "array", "items": self.item.describe(known), "minItems": self.least, "maxItems": self.most, "uniqueItems": self.distinct}
        return {k: v for k, v in out.items() if v}


class TextMap(Shape):
    """A non-empty object of strings, kept as ordered pairs."""

    def read(self, value: Any, path: str) -> tuple:
        if type(value) is not dict or not value:
            raise Problem(path, "must be a non-empty object")
        return tuple((k, Text().read(v, f"{path}.{k}")) for k, v in value.items())

    def write(self, value: tuple) -> dict:
        return dict(value)

    def describe(self, known: dict) -> dict:
        return {"type": "object", "minProperties": 1, "additionalProperties": {"type": "string"}}


_NEEDED = object()


def need(shape: Shape) -> Any:
    return dataclasses.field(metadata={"shape": shape, "default": _NEEDED})


def may(shape: Shape, default: Any = None) -> Any:
    return dataclasses.field(default=default, metadata={"shape": shape, "default": default})


def tag(name: str) -> Any:
    """The field that tells a variant from others."""
    return dataclasses.field(default=name, metadata={"shape": Choice((name,)), "default": name})


@dataclass_transform(frozen_default=True, kw_only_default=True, field_specifiers=(need, may, tag))
def shaped(cls: type) -> type:
    return dataclasses.dataclass(frozen=True, kw_only=True)(cls)


class Record:
    def rules(self) -> Iterator[str]:
        yield from ()


@dataclasses.dataclass(frozen=True)
class Object(Shape):
    cls: type

    def read(self, value: Any, path: str) -> Any:
        if type(value) is not dict:
            raise Problem(path, "must be an object")
        fields = {f.name: f for f in dataclasses.fields(self.cls)}
        at = lambda name: f"{path}.{name}" if path else name
        for name in value:
            if name not in fields:
                raise Problem(at(name), "no such field")
        out = {}
        for name, field in fields.items():
            if name in value and not (value[name] is None and field.metadata["default"] is None):
                out[name] = field.metadata["shape"].read(value[name], at(name))
            elif field.metadata["default"] is _NEEDED:
                raise Problem(at(name), "is required")
        made = self.cls(**out)
        for wrong in made.rules():
            raise Problem(path, wrong)
        return made

    def write(self, value: Any) -> dict:
        found = ((f, getattr(value, f.name)) for f in dataclasses.fields(self.cls))
        return {f.name: f.metadata["shape"].write(v) for f, v in found if v is not None}

    def describe(self, known: dict) -> dict:
        name = self.cls.__name__
        if name not in known:
            known[name] = {}
            fields = dataclasses.fields(self.cls)
            known[name] |= {
                "type": "object",
                "additionalProperties": False,
                "properties": {f.name: f.metadata["shape"].describe(known) | ({"default": self._default(f)} if self._default(f) is not None else {}) for f in fields},
                "required": [f.name for f in fields if f.metadata["default"] is _NEEDED],
            }
            if self.cls.__doc__ and not self.cls.__doc__.startswith(name):
                known[name]["description"] = self.cls.__doc__.split("\n")[0]
        return {"$ref": f"#/$defs/{name}"}

    @staticmethod
    def _default(field: dataclasses.Field) -> Any:
        default = field.metadata["default"]
        return None if default is _NEEDED or default is None else field.metadata["shape"].write(default)


class Variants(Shape):
    """One of several objects, told apart by the field `by`; filled later, so that variants may hold each other."""

    def __init__(self, by: str):
        self.by, self.of = by, {}

    def add(self, *classes: type) -> Variants:
        for cls in classes:
            self.of[next(f for f in dataclasses.fields(cls) if f.name == self.by).default] = Object(cls)
        return self

    def read(self, value: Any, path: str) -> Any:
        if type(value) is not dict:
            raise Problem(path, "must be an object")
        kind = value.get(self.by)
        if type(kind) is not str or kind not in self.of:
            raise Problem(f"{path}.{self.by}", f"must be one of {', '.join(self.of)}")
        return self.of[kind].read(value, path)

    def write(self, value: Any) -> dict:
        return self.of[getattr(value, self.by)].write(value)

    def describe(self, known: dict) -> dict:
        return {"oneOf": [o.describe(known) for o in self.of.values()], "discriminator": {"propertyName": self.by}}
