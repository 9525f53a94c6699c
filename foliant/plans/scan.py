"""Queries as one boolean expression over a scan, so that the engine prunes columns and pushes filters down.

An expression may be null where it means false; `not` closes that gap, hence a row without the field satisfies the negation. At the top a null counts
as false as well, which is what a filter does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import query as q
from ..operators.fields import SAFE, Fields


def condition(query: q.Query, fields: Fields) -> Column:
    return _condition(q.simplify(query), fields)


def _condition(x: q.Query, f: Fields) -> Column:
    if isinstance(x, q.All):
        return F.lit(True)
    if isinstance(x, q.Nothing):
        return F.lit(False)
    if isinstance(x, q.Named):
        return _condition(x.part, f)
    if isinstance(x, q.And):
        return reduce(lambda a, b: a & b, [_condition(p, f) for p in x.parts])
    if isinstance(x, q.Or):
        return reduce(lambda a, b: a | b, [_condition(p, f) for p in x.parts])
    if isinstance(x, q.Not):
        return ~F.coalesce(_condition(x.part, f), F.lit(False))
    if isinstance(x, q.HasToken):
        return has_token(x, f)
    if isinstance(x, q.HasNumber):
        return in_range(x.field, x.value, x.value, f)
    if isinstance(x, q.InRange):
        return in_range(x.field, x.low, x.high, f)
    if isinstance(x, q.Present):
        return f.present(x.field)
    if isinstance(x, q.TokenRange):
        low = [] if x.low is None else [lambda t: t >= x.low]
        high = [] if x.high is None else [lambda t: t < x.high]
        return F.exists(f.terms(x.field), lambda t: reduce(lambda a, b: a & b, [b(t) for b in low + high], F.lit(True)))
    if isinstance(x, q.Contains):
        return F.exists(f.raw(x.field, "s"), lambda v: F.contains(F.lower(v), F.lower(F.lit(x.text))))
    raise TypeError(f"not a query: {x!r}")


def has_token(x: q.HasToken, f: Fields) -> Column:
    strings = [v for v in x.values if isinstance(v, str)]
    booleans = [v for v in x.values if isinstance(v, bool)]
    parts: list[Column] = []
    single = None if f.is_all(x.field) else f.scalar(x.field)
    config = None if f.is_all(x.field) else f.config.of(x.field)
    quick = matches(strings, x.field, f)
    if quick is not None:
        parts += quick
    elif strings:
        if single is not None and config.searchable and config.analyzer is None and isinstance(single.kind, T.StringType):
            parts.append(single.column.isin(strings) if len(strings) > 1 else single.column == strings[0])
        elif len(strings) == 1:
            parts.append(F.array_contains(f.terms(x.field), strings[0]))
        else:
            parts.append(F.arrays_overlap(f.terms(x.field), F.array(*map(F.lit, strings))))
    for b in booleans:
        if single is not None and config.searchable and isinstance(single.kind, T.BooleanType):
            parts.append(single.column == b)
        else:
            parts.append(F.array_contains(f.values(x.field, "b"), b))
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def matches(terms: list[str], name: str | None, f: Fields) -> list[Column] | None:
    """Conditions on the columns themselves, where the analyzer has them: no array of terms is built for them."""
    names = [n for n in f.names() if f.config.of(n).in_all] if f.is_all(name) else [name]
    config = f.config.catch_all if f.is_all(name) else f.config.of(name)
    test = getattr(config.analyzer, "matches", None)
    if not test or not config.searchable:
        return None
    out = []
    for n in names:
        p = f.scalar(n)
        if p is None:
            return None
        if isinstance(p.kind, T.StringType):
            out += [test(p.column, t) for t in terms]
    return None if any(c is None for c in out) else out


def in_range(name: str | None, low: int | None, high: int | None, f: Fields) -> Column:
    """Floored values between bounds. On a single typed column this is a comparison of the column itself, which scans can use."""
    single = None if f.is_all(name) else f.scalar(name)
    low, high = (None if low is None else max(low, -SAFE)), (None if high is None else min(high, SAFE))
    if single is not None and f.config.of(name).searchable and isinstance(single.kind, T.NumericType):
        c, bounds = single.column, []
        exact = isinstance(single.kind, T.IntegralType)
        wide = isinstance(single.kind, T.LongType) or not exact
        if low is not None or wide:
            bounds.append(c >= F.lit(-SAFE if low is None else low))
        if high is not None or wide:
            top = SAFE if high is None else high
            # NaN is above every number, so the upper bound leaves it out
            bounds.append(c <= F.lit(top) if exact or top == SAFE else c < F.lit(top + 1))
        return reduce(lambda a, b: a & b, bounds)

    def inside(v: Column) -> Column:
        return reduce(lambda a, b: a & b, ([v >= F.lit(low)] if low is not None else []) + ([v <= F.lit(high)] if high is not None else []), F.lit(True))

    if low is not None and low == high:
        return F.array_contains(f.values(name, "n"), F.lit(low).cast("bigint"))
    return F.exists(f.values(name, "n"), inside)
