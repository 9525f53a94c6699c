"""Aggregations: count, first, last, group-by that nest, and buckets.

Results are flat rows: a column for each group key and for each aggregate, a table for each level that has aggregates. First
and last are one aggregate over (keys, _id), so each level is one partial and one final aggregation; only sorts of mixed
directions need a window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sorting import Sort, keys
from .fields import Fields, OpenFields, TypedFields


@dataclass(frozen=True)
class Count:
    alias: str = "count"


@dataclass(frozen=True)
class First:
    """The row that comes first in the order; of equals, the one of least _id."""

    sort: tuple
    projection: tuple[str, ...] | None = None
    alias: str = "first"
    last: bool = False


@dataclass(frozen=True)
class GroupBy:
    """`size` cuts numbers into ranges of that width; `each` counts a row in the group of each of its terms."""

    field: str
    parts: tuple
    alias: str | None = None
    size: float | None = None
    each: bool = False


def count(alias: str = "count") -> Count:
    return Count(alias)


def first(sort: Sort, projection: list[str] | None = None, alias: str = "first") -> First:
    return First(tuple(sort), None if projection is None else tuple(projection), alias)


def last(sort: Sort, projection: list[str] | None = None, alias: str = "last") -> First:
    return First(tuple(sort), None if projection is None else tuple(projection), alias, True)


def group_by(field: str, parts: list, alias: str | None = None) -> GroupBy:
    return GroupBy(field, tuple(parts), alias)


def bucket_term(field: str, parts: list, alias: str | None = None) -> GroupBy:
    return GroupBy(field, tuple(parts), alias, each=True)


def bucket_number(field: str, size: float, parts: list, alias: str | None = None) -> GroupBy:
    if not size > 0:
        raise ValueError("a bucket's size must be above 0")
    return GroupBy(field, tuple(parts), alias, size=size)


def payload(a: First, fields: Fields, df: DataFrame) -> Column:
    if a.projection is None:
        return F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return F.struct(F.col("_id"), *[fields.output(n) for n in a.projection])


def reversed_order(c: Column, kind: T.DataType) -> Column:
    """A value that orders as c does, the other way round; nulls come last."""
    if isinstance(kind, T.StructType):
        return F.struct(*[x.alias(f"r{2 * i + k}") for i, f in enumerate(kind) for k, x in enumerate((c[f.name].isNull(), reversed_order(c[f.name], f.dataType)))])
    if isinstance(kind, T.ArrayType):
        each = F.transform(c, lambda x: F.struct(F.lit(False).alias("end"), x.isNull().alias("none"), reversed_order(x, kind.elementType).alias("value")))
        end = F.struct(F.lit(True).alias("end"), F.lit(True).alias("none"), reversed_order(F.lit(None).cast(kind.elementType), kind.elementType).alias("value"))
        return F.concat(each, F.array(end))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.concat(F.translate(F.hex(c.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(c)
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return -F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.NumericType):
        return -c
    raise ValueError(f"an _id of type {kind.simpleString()} has no order")


def group_key(g: GroupBy, fields: Fields) -> Column:
    if g.each:
        return F.explode_outer(F.array_distinct(F.concat(fields.terms(g.field), F.transform(fields.values(g.field, "n"), lambda x: x.cast("string")))))
    if isinstance(fields, TypedFields):
        p = fields.paths.get(g.field)
        if p is None:
            return F.lit(None).cast("string")
        if p.many or isinstance(p.kind, T.BooleanType):
            raise ValueError(f"{g.field} has no single string or number to group by; use bucket_term")
        return p.column if g.size is None else (F.floor(p.column / F.lit(g.size)) * F.lit(g.size))
    if not isinstance(fields, OpenFields):
        raise TypeError(type(fields))
    n, s = F.get(fields.raw(g.field, "n"), F.lit(0)), F.get(fields.raw(g.field, "s"), F.lit(0))
    return F.coalesce(s, n.cast("string")) if g.size is None else F.floor(n / F.lit(g.size)) * F.lit(g.size)


def aggregate(df: DataFrame, fields: Fields, parts: list) -> list[DataFrame]:
    """A table for the counts, firsts and lasts of each level, outermost first."""
    return _level(df, fields, parts, [])


def _level(df: DataFrame, fields: Fields, parts: list, by: list[tuple[str, Column]]) -> list[DataFrame]:
    out = []
    own = [p for p in parts if not isinstance(p, GroupBy)]
    if own:
        out.append(_own(df, fields, own, by))
    for g in parts:
        if isinstance(g, GroupBy):
            name = g.alias or g.field
            if name in [n for n, _ in by]:
                raise ValueError(f"two groups are called {name}")
            hidden = f"__group_{len(by)}"
            out += _level(df.withColumn(hidden, group_key(g, fields)), fields, list(g.parts), [*by, (name, F.col(hidden))])
    return out


def _own(df: DataFrame, fields: Fields, own: list, by: list[tuple[str, Column]]) -> DataFrame:
    visible = df.select([F.col(f"`{c}`") for c in df.columns if not c.startswith("__group_")])
    groups = [c.alias(n) for n, c in by]
    aggs, windows = [], []
    for a in own:
        if isinstance(a, Count):
            aggs.append(F.count(F.lit(1)).alias(a.alias))
            continue
        ks = keys(list(a.sort), fields)
        down = {d for _, d in ks}
        if len(down) > 1:
            windows.append((a, ks))
            continue
        descending = bool(ks) and ks[0][1]
        least = descending == a.last  # the least key comes out
        rank = F.struct(*[k.alias(f"k{i}") for i, (k, _) in enumerate(ks)], *(x.alias(f"id{i}") for i, x in enumerate([F.col("_id")] if least else [F.col("_id").isNull(), reversed_order(F.col("_id"), visible.schema["_id"].dataType)])))
        aggs.append((F.min_by if least else F.max_by)(payload(a, fields, visible), rank).alias(a.alias))
    if not windows:
        return df.groupBy(*groups).agg(*aggs)
    # a window for each mixed order marks its row; one aggregation then collects them
    for i, (a, ks) in enumerate(windows):
        flip = a.last
        order = [k.desc_nulls_last() if d != flip else k.asc_nulls_first() for k, d in ks] + [F.col("_id").asc()]
        df = df.withColumn(f"__rank_{i}", F.row_number().over(Window.partitionBy(*[c for _, c in by]).orderBy(*order)))
        aggs.append(F.max(F.when(F.col(f"__rank_{i}") == 1, payload(a, fields, visible))).alias(a.alias))
    names = [a.alias for a in own]
    return df.groupBy(*groups).agg(*aggs).select(*[F.col(f"`{n}`") for n, _ in by], *names)


def nested(flat: DataFrame, outer: list[str], alias: str = "groups") -> DataFrame:
    """Rows of inner groups gathered into an array for each outer group."""
    rest = [c for c in flat.columns if c not in outer]
    return flat.groupBy(*[F.col(f"`{c}`") for c in outer]).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(alias))
