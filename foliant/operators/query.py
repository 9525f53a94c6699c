"""The query language: an immutable tree, its builders, and a simplifier that knows no data."""

from __future__ import annotations

import math
from dataclasses import dataclass

Token = str | bool | int | float


class Query:
    def __and__(self, other: Query) -> Query:
        return and_(self, other)

    def __or__(self, other: Query) -> Query:
        return or_(self, other)

    def __invert__(self) -> Query:
        return Not(self)


@dataclass(frozen=True)
class All(Query):
    pass


@dataclass(frozen=True)
class Nothing(Query):
    pass


@dataclass(frozen=True)
class HasToken(Query):
    values: tuple[str | bool, ...]
    field: str | None = None


@dataclass(frozen=True)
class HasNumber(Query):
    value: int
    field: str | None = None


@dataclass(frozen=True)
class InRange(Query):
    """Whole numbers from low to high, both included; None is open."""

    field: str
    low: int | None
    high: int | None


@dataclass(frozen=True)
class TokenRange(Query):
    """Terms from low (included) to high (excluded), by code point; None is open."""

    field: str
    low: str | None
    high: str | None


@dataclass(frozen=True)
class Contains(Query):
    """The value holds this text, whatever the case."""

    field: str
    text: str


@dataclass(frozen=True)
class Present(Query):
    field: str


@dataclass(frozen=True)
class And(Query):
    parts: tuple[Query, ...]


@dataclass(frozen=True)
class Or(Query):
    parts: tuple[Query, ...]


@dataclass(frozen=True)
class Not(Query):
    part: Query


@dataclass(frozen=True)
class Groups(Query):
    """Every `must`, none of `must_not`, and, if there are any, at least one `should`."""

    should: tuple[Query, ...] = ()
    must: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()


@dataclass(frozen=True)
class Named(Query):
    """A filter that an index registers, and may keep, under a name."""

    name: str
    part: Query


def all_() -> Query:
    return All()


def token(value: Token | list[Token], field: str | None = None) -> Query:
    """Any of the values is a term of the field (of the catch-all field if none is given). Values are not analysed."""
    values = tuple(value) if isinstance(value, (list, tuple, set, frozenset)) else (value,)
    numbers = [number(v, field) for v in values if not isinstance(v, (str, bool))]
    if not numbers:
        return HasToken(values, field)
    others = tuple(v for v in values if isinstance(v, (str, bool)))
    return or_(*numbers, *([HasToken(others, field)] if others else []))


def number(value: float, field: str | None = None) -> Query:
    return HasNumber(math.floor(value), field)


def number_range(field: str, low: float | None = None, high: float | None = None, low_included: bool = True, high_included: bool = False) -> Query:
    """Floored numbers of the field between the bounds; None and infinities are open ends, 0 is 0."""
    low = None if low is None or low == -math.inf else low
    high = None if high is None or high == math.inf else high
    if low is None and high is None:
        raise ValueError("a range needs a bound; use present() for any value")
    if any(x is not None and math.isnan(x) for x in (low, high)) or low == math.inf or high == -math.inf:
        return Nothing()
    least = None if low is None else math.ceil(low) if low_included else math.floor(low) + 1
    most = None if high is None else math.floor(high) if high_included else math.ceil(high) - 1
    return Nothing() if least is not None and most is not None and least > most else InRange(field, least, most)


def token_range(field: str, low: str | None = None, high: str | None = None) -> Query:
    return TokenRange(field, low, high)


def contains(text: str, field: str) -> Query:
    return Contains(field, text)


def present(field: str) -> Query:
    return Present(field)


def and_(*parts: Query) -> Query:
    return And(parts) if parts else All()


def or_(*parts: Query) -> Query:
    """Without parts this is everything, as and_() is."""
    return Or(parts) if parts else All()


def not_(part: Query) -> Query:
    return Not(part)


def named(name: str, part: Query) -> Query:
    return Named(name, part)


def simplify(q: Query) -> Query:
    """An equal query without nesting of one kind, double negations, repetitions and parts that decide nothing."""
    if isinstance(q, Named):
        return Named(q.name, simplify(q.part))
    if isinstance(q, Not):
        p = simplify(q.part)
        return Nothing() if p == All() else All() if p == Nothing() else p.part if isinstance(p, Not) else Not(p)
    if isinstance(q, Groups):
        any_of = [Or(q.should)] if q.should else []
        return simplify(and_(*q.must, *any_of, *map(Not, q.must_not)))
    if isinstance(q, (And, Or)):
        kind, stop, skip = (And, Nothing(), All()) if isinstance(q, And) else (Or, All(), Nothing())
        flat: list[Query] = []
        for p in map(simplify, q.parts):
            flat += p.parts if type(p) is kind else [p]
        flat = [p for p in dict.fromkeys(flat) if p != skip]
        if stop in flat or any(Not(p) in flat for p in flat):
            return stop
        return skip if not flat else flat[0] if len(flat) == 1 else kind(tuple(flat))
    return q


def fields_of(q: Query) -> set[str | None]:
    """The fields that a query names; None for the catch-all."""
    if isinstance(q, (And, Or)):
        return set().union(*map(fields_of, q.parts))
    if isinstance(q, (Not, Named)):
        return fields_of(q.part)
    if isinstance(q, Groups):
        return set().union(*map(fields_of, q.should + q.must + q.must_not))
    return {q.field} if hasattr(q, "field") else set()
