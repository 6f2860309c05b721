"""strftime formats as Spark datetime patterns."""

from __future__ import annotations

# What each directive is in a Spark pattern, alone and between other digits.
_LOOSE = {"Y": "yyyy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "f": "SSSSSS", "j": "D", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "z": "Z"}
_TIGHT = _LOOSE | {"m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "j": "DDD"}
_DIGITS = frozenset("YmdHIMSfj")
_WHOLE = {"F": "%Y-%m-%d", "T": "%H:%M:%S"}


def spark_pattern(fmt: str) -> str:
    """The pattern for a strftime format. Fields take one digit or two unless another field or digit follows at once.

    Directives without a safe counterpart (such as %y, whose century differs) raise ValueError.
    """
    for short, whole in _WHOLE.items():
        fmt = fmt.replace(f"%{short}", whole)
    parts: list[tuple[str, bool]] = []
    at = 0
    while at < len(fmt):
        if fmt[at] != "%":
            parts.append((fmt[at], False))
            at += 1
        elif at + 1 < len(fmt) and fmt[at + 1] == "%":
            parts.append(("%", False))
            at += 2
        elif at + 1 < len(fmt) and fmt[at + 1] in _LOOSE:
            parts.append((fmt[at + 1], True))
            at += 2
        else:
            raise ValueError(f"no counterpart for the directive %{fmt[at + 1 : at + 2]}")
    digits = [(field and x in _DIGITS) or (not field and x.isdigit()) for x, field in parts]
    out, quoted = [], ""
    for k, (x, field) in enumerate(parts):
        if not field:
            quoted += x
            continue
        out.append(_quote(quoted))
        quoted = ""
        tight = (k > 0 and digits[k - 1]) or (k + 1 < len(parts) and digits[k + 1])
        out.append((_TIGHT if tight else _LOOSE)[x])
    return "".join(out) + _quote(quoted)


def _quote(text: str) -> str:
    if not any(c.isalpha() or c in "'[]{}#" for c in text):
        return text
    return "'" + text.replace("'", "''") + "'"
