"""Values of the generators as Spark columns over a row number."""

from __future__ import annotations

import datetime as dt
import math
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from layerloom.errors import StageError
from layerloom.functions.casts import float_text
from layerloom.functions.expressions import name
from layerloom.sources.domains import VAST
from layerloom.sources.random import below, permuted, uniform
from layerloom.spec import model as m
from layerloom.types import BOOLEAN, FLOAT, TIMESTAMP, literal

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)

# Everyday German names and places, from which plausible data is put together.
FIRST_NAMES = "Anna Ben Clara David Emma Felix Greta Hannes Ida Jonas Katja Lukas Marie Nils Olga Paul Rosa Stefan Theo Ulrike".split()
LAST_NAMES = "Bauer Becker Fischer Hoffmann Klein Koch Krüger Lehmann Meyer Müller Neumann Richter Schäfer Schmidt Schneider Schröder Schulz Wagner Weber Zimmermann".split()
CITIES = "Aachen Augsburg Berlin Bochum Bonn Bremen Dortmund Dresden Düsseldorf Erfurt Essen Frankfurt Freiburg Hamburg Hannover Jena Kassel Kiel Köln Leipzig Lübeck Mainz Mannheim München Münster Nürnberg Potsdam Rostock Stuttgart Würzburg".split()
STREETS = "Ahornweg Bahnhofstraße Bergstraße Birkenallee Dorfstraße Eichenweg Gartenstraße Goethestraße Hauptstraße Kirchplatz Lindenallee Marktplatz Mühlenweg Ringstraße Rosenweg Schillerstraße Schulstraße Talstraße Waldweg Wiesenweg".split()
FORMS = ["GmbH", "AG", "KG", "OHG", "e.K.", "GmbH & Co. KG"]
HOSTS = ["beispiel.de", "example.de", "example.org", "example.net"]


def lattice(g: m.FloatRange) -> tuple[int, int]:
    """The first and last multiple of 10 ** -decimal_places within the bounds as they are written."""
    scale = Decimal(10) ** g.decimal_places
    low = int((Decimal(repr(g.min)) * scale).to_integral_value(ROUND_CEILING))
    high = int((Decimal(repr(g.max)) * scale).to_integral_value(ROUND_FLOOR))
    if low > high:
        raise StageError("generate", f"no value of {g.decimal_places} decimal places lies between {g.min} and {g.max}")
    return low, high


def _micros(t: dt.datetime) -> int:
    return (t - _EPOCH) // dt.timedelta(microseconds=1)


def lattice_size(g: m.Record) -> int | None:
    """The size of a domain that is evenly spaced: decimals, days, microseconds."""
    match g:
        case m.FloatRange():
            low, high = lattice(g)
            return high - low + 1
        case m.DateRange():
            return (g.max - g.min).days + 1
        case m.TimestampRange():
            return _micros(g.max) - _micros(g.min) + 1
    return None


def at_index(g: m.Record, index: Column) -> Column:
    """The value with an index in the domain of a generator that has one."""
    match g:
        case m.FormattedId():
            number = (F.lit(g.start).cast("bigint") + index).cast("string")
            return F.concat(F.lit(g.prefix), F.lpad(number, g.digits, "0"))
        case m.IntegerRange():
            return F.lit(g.min).cast("bigint") + index
        case m.FloatRange():
            low, _ = lattice(g)
            return ((F.lit(low).cast("bigint") + index).cast("decimal(38,0)") / F.lit(10**g.decimal_places).cast("decimal(13,0)")).cast("double")
        case m.DateRange():
            return F.date_add(F.lit(g.min), index.cast("int"))
        case m.TimestampRange():
            return F.timestamp_micros(F.lit(_micros(g.min)).cast("bigint") + index)
        case m.Categorical():
            return F.element_at(F.array(*map(literal, g.values)), (index + 1).cast("int"))
        case m.BooleanDraw():
            return index == 1
        case m.RandomString():
            return _string_at(g, index)
    raise TypeError(f"{g.kind} has no indexed domain")


def possible_at(g: m.Record, index: Column) -> Column:
    """The value with an index among those that have a weight or a chance."""
    match g:
        case m.Categorical() if g.weights is not None:
            live = [literal(v) for v, w in zip(g.values, g.weights, strict=True) if w > 0]
            return F.element_at(F.array(*live), (index + 1).cast("int"))
        case m.BooleanDraw() if not 0 < g.true_probability < 1:
            return F.lit(g.true_probability > 0)
    return at_index(g, index)


def _letters(alphabet: str, index: Column, n: int) -> Column:
    """index in base len(alphabet) as n letters; letters beyond what any index needs follow from a hash of it."""
    k = len(alphabet)
    if k == 1:
        return F.lit(alphabet * n)
    own = min(n, math.ceil(52 / math.log2(k)))
    base = F.lit(k).cast("bigint")

    def letter(p: Column) -> Column:
        place = F.pow(F.lit(float(k)), F.least(p, F.lit(own - 1))).cast("bigint")
        digit = F.when(p < own, F.pmod(F.call_function("div", index, place), base)).otherwise(below(k, 0, index, p))
        return F.substring(F.lit(alphabet), (digit + 1).cast("int"), F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), letter), "")


def _string_at(g: m.RandomString, index: Column) -> Column:
    """The string with an index: shorter ones first, as many lengths as 2 ** 52 values need."""
    out, passed = None, 0
    for n in range(g.min_length, g.max_length + 1):
        size = len(g.alphabet) ** n
        word = _letters(g.alphabet, index - F.lit(passed).cast("bigint"), n)
        out = F.when(index < passed + min(size, VAST), word) if out is None else out.when(index < min(passed + size, VAST), word)
        passed += size
        if passed >= 1 << 52:
            break
    return out


def capacity(g: m.Record) -> int | None:
    """The number of indexes at_index takes; those of long strings are bounded to what doubles count exactly."""
    from layerloom.sources.domains import domain_size

    size = domain_size(g)
    size = lattice_size(g) if size is None else size
    return min(size, 1 << 52) if isinstance(g, m.RandomString) and size is not None else size


def drawn(g: m.Record, row: Column, key: int) -> Column:
    """An independent draw for each row."""
    match g:
        case m.FormattedId():
            return at_index(g, row)
        case m.Categorical() if g.weights is not None:
            return _weighted(g, uniform(key, row))
        case m.BooleanDraw():
            return uniform(key, row) < g.true_probability
        case m.RandomString():
            length = F.lit(g.min_length).cast("bigint") + below(g.max_length - g.min_length + 1, key, row, F.lit(-1))
            letter = lambda p: F.substring(F.lit(g.alphabet), (below(len(g.alphabet), key, row, p) + 1).cast("int"), F.lit(1))
            return F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), length), letter), "")
        case _ if isinstance(g, m.PLAUSIBLE):
            return _plausible(g, row, key)
    return at_index(g, below(capacity(g), key, row))


def distinct(g: m.Record, row: Column, n: int, key: int) -> Column:
    """Draws without replacement for rows 0 to n - 1."""
    if isinstance(g, m.FormattedId):
        return at_index(g, row)
    if isinstance(g, m.PLAUSIBLE):  # the row number makes each one different
        mark = F.concat(F.lit(" "), (row + 1).cast("string"))
        return F.concat((row + 1).cast("string"), F.lit("."), _plausible(g, row, key)) if isinstance(g, m.Email) else F.concat(_plausible(g, row, key), mark)
    if isinstance(g, m.Categorical) and g.weights is not None:
        live = [(v, w, i) for i, (v, w) in enumerate(zip(g.values, g.weights, strict=True)) if w > 0]
        if len(live) < n:
            raise StageError("generate", f"{len(live)} values with a weight for {n} rows")
        from layerloom.sources.random import stream

        chance = lambda i: (stream("", key, f"weight/{i}") + 1) / (2**63 + 1)  # noqa: E731  exponential keys: the order of weighted draws
        order = sorted(live, key=lambda x: -math.log(chance(x[2])) / x[1])
        return F.element_at(F.array(*[literal(v) for v, _, _ in order]), (row + 1).cast("int"))
    size = capacity(g)
    if size is None:
        return drawn(g, row, key)
    if size < n:
        raise StageError("generate", f"{size} values for {n} distinct rows")
    return at_index(g, permuted(row, size, key))


def _weighted(g: m.Categorical, u: Column) -> Column:
    total, passed, out = sum(g.weights), 0.0, None
    live = [(v, w) for v, w in zip(g.values, g.weights, strict=True) if w > 0]
    for v, w in live[:-1]:
        passed += w / total
        out = F.when(u < passed, literal(v)) if out is None else out.when(u < passed, literal(v))
    last = literal(live[-1][0])
    return last if out is None else out.otherwise(last)


def _plausible(g: m.Record, row: Column, key: int) -> Column:
    pick = lambda pool, draw: F.element_at(F.array(*map(F.lit, pool)), (below(len(pool), key, row, F.lit(draw)) + 1).cast("int"))
    number = lambda low, high, draw: (F.lit(low) + below(high - low + 1, key, row, F.lit(draw))).cast("string")
    first, last = pick(FIRST_NAMES, 0), pick(LAST_NAMES, 1)
    match g:
        case m.PersonName():
            return F.concat_ws(" ", first, last)
        case m.Email():
            plain = F.translate(F.lower(F.concat_ws(".", first, last)), "äöü", "aou")
            return F.concat(plain, number(1, 999, 2), F.lit("@"), pick(HOSTS, 3))
        case m.City():
            return pick(CITIES, 0)
        case m.StreetAddress():
            return F.concat(pick(STREETS, 0), F.lit(" "), number(1, 180, 1), F.lit(", "), F.lpad(number(1067, 99998, 2), 5, "0"), F.lit(" "), pick(CITIES, 3))
        case m.CompanyName():
            return F.concat_ws(" ", last, pick(FORMS, 2))
    return F.concat(F.lit("+49 "), number(30, 999, 0), F.lit(" "), number(100000, 9999999, 1))


def text_form(column: str, kind: str) -> Column:
    """How a value appears in a template; null stays null."""
    x = name(column)
    if kind == FLOAT:
        return float_text(x)
    if kind == TIMESTAMP:
        micros = F.pmod(F.unix_micros(x), F.lit(1_000_000))
        fraction = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit(""))
        return F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
    return F.lower(x.cast("string")) if kind == BOOLEAN else x.cast("string")


def templated(g: m.Template, kinds: dict[str, str]) -> Column:
    """The template with its columns filled in; null if any of them is."""
    parts, at = [], 0
    for found in m.PLACEHOLDER.finditer(g.template):
        parts += [F.lit(g.template[at : found.start()]), text_form(found[1], kinds[found[1]])]
        at = found.end()
    return F.concat(*parts, F.lit(g.template[at:]))


__all__ = ["at_index", "capacity", "distinct", "drawn", "lattice_size", "possible_at", "templated"]
