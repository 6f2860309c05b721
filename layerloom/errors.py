"""Errors with stable codes: one for a document that can't be read, many issues for one that makes no sense."""

from __future__ import annotations

from dataclasses import dataclass

DUPLICATE_KEY, TOO_LARGE, TOO_DEEP, MALFORMED = "P001", "P002", "P003", "P004"


class ParseError(ValueError):
    """The document doesn't conform to the language's grammar."""

    def __init__(self, code: str, path: str, message: str):
        super().__init__(f"{code} at {path or '$'}: {message}")
        self.code, self.path, self.message = code, path, message


@dataclass(frozen=True, order=True)
class Issue:
    """A semantic defect; issues sort by path, then code."""

    path: str
    code: str
    message: str

    def __str__(self) -> str:
        return f"{self.code} at {self.path}: {self.message}"


class SemanticError(ValueError):
    """The document is well formed but can't be a pipeline."""

    def __init__(self, issues: list[Issue]):
        self.issues = tuple(sorted(set(issues)))
        super().__init__("\n".join(map(str, self.issues)))

    @property
    def codes(self) -> tuple[str, ...]:
        return tuple(i.code for i in self.issues)


class StageError(RuntimeError):
    """A stage of building an instance failed."""

    def __init__(self, stage: str, message: str, details: tuple = ()):
        super().__init__(f"{stage}: {message}")
        self.stage, self.message, self.details = stage, message, details
