"""Reading a scenario document, its canonical form and hash, and the language's JSON Schema."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from pathlib import Path
from typing import Any

from layerloom import errors
from layerloom.spec import model as m
from layerloom.spec.shapes import Object, Problem

MOST_BYTES, MOST_DEPTH = 5 * 1024 * 1024, 16
_ROOT = Object(m.Scenario)


def _no_duplicates(pairs: list[tuple[str, Any]]) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key in out:
            raise errors.ParseError(errors.DUPLICATE_KEY, key, "the key occurs twice in one object")
        out[key] = value
    return out


def _depth(node: Any) -> int:
    """How deep expressions and conditions nest below a node, itself included."""
    inner = [getattr(node, f.name) for f in dataclasses.fields(node)]
    items = [y for x in inner for y in (x if isinstance(x, tuple) else (x,)) if isinstance(y, m.Expression | m.Condition)]
    return 1 + max(map(_depth, items), default=0)


def _check_depth(node: Any, path: str) -> None:
    for field in dataclasses.fields(node):
        value = getattr(node, field.name)
        for i, item in enumerate(value if isinstance(value, tuple) else (value,)):
            at = f"{path}.{field.name}" + (f".{i}" if isinstance(value, tuple) else "")
            if isinstance(item, m.Expression | m.Condition):
                if _depth(item) > MOST_DEPTH:
                    raise errors.ParseError(errors.TOO_DEEP, at.lstrip("."), f"nests deeper than {MOST_DEPTH}")
            elif isinstance(item, m.Record):
                _check_depth(item, at)


def parse(data: bytes | str, most_bytes: int = MOST_BYTES) -> m.Scenario:
    """The scenario that a JSON document declares."""
    raw = data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data
    if len(raw) > most_bytes:
        raise errors.ParseError(errors.TOO_LARGE, "", f"{len(raw)} bytes; {most_bytes} at most")
    try:
        value = json.loads(raw.decode("utf-8"), object_pairs_hook=_no_duplicates)
    except errors.ParseError:
        raise
    except RecursionError as e:
        raise errors.ParseError(errors.TOO_DEEP, "", "nests too deep to be read") from e
    except ValueError as e:
        raise errors.ParseError(errors.MALFORMED, "", str(e)) from e
    try:
        scenario = _ROOT.read(value, "")
    except Problem as e:
        raise errors.ParseError(errors.MALFORMED, e.path, e.message) from e
    except RecursionError as e:
        raise errors.ParseError(errors.TOO_DEEP, "", "nests too deep to be read") from e
    _check_depth(scenario, "")
    return scenario


def parse_file(path: str | Path, most_bytes: int = MOST_BYTES) -> m.Scenario:
    return parse(Path(path).read_bytes(), most_bytes)


def canonical(scenario: m.Scenario) -> bytes:
    """One spelling for all documents that mean the same: defaults written out, keys sorted, times in UTC."""
    return json.dumps(_ROOT.write(scenario), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def content_hash(scenario: m.Scenario) -> str:
    return hashlib.sha256(canonical(scenario)).hexdigest()


def json_schema() -> dict:
    known: dict = {}
    root = _ROOT.describe(known)
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Scenario 1.0", **root, "$defs": dict(sorted(known.items()))}


def export_json_schema(path: str | Path) -> None:
    Path(path).write_text(json.dumps(json_schema(), indent=2, sort_keys=True) + "\n")
