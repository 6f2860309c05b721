"""How many distinct values a generator can make, where that can be told."""

from __future__ import annotations

from layerloom.spec import model as m

#: Beyond this a domain counts as boundless for keys.
VAST = 1 << 62


def domain_size(g: m.Record) -> int | None:
    """The number of distinct values, VAST at most; None where it depends on other tables or isn't known."""
    match g:
        case m.FormattedId():
            size = 10**g.digits - g.start
        case m.IntegerRange():
            size = g.max - g.min + 1
        case m.Categorical():
            size = len(g.values)
        case m.BooleanDraw():
            size = 2
        case m.RandomString():
            size = sum(len(g.alphabet) ** n for n in range(g.min_length, min(g.max_length, g.min_length + 64) + 1))
        case _:
            return None
    return max(0, min(size, VAST))


def possible(g: m.Record) -> int | None:
    """As domain_size, without values that have no weight or no chance."""
    match g:
        case m.Categorical() if g.weights is not None:
            return sum(w > 0 for w in g.weights)
        case m.BooleanDraw():
            return 1 + (0 < g.true_probability < 1)
    return domain_size(g)
