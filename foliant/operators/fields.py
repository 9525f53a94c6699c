"""What the compiler asks of a table's fields, whether the table is typed or holds open documents.

Every answer is an expression: terms, numbers and booleans of a field as arrays, its presence, its key for sorting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ALL_FIELD, FieldConfig, IndexConfig
from ..functions.analyzers import over
from ..functions.flatten import FIELDS, SAFE, Path, paths

ALL_NAMES = (ALL_FIELD,)
COLLATION = "UNICODE_CI_AI"
_STRINGS, _LONGS, _BOOLEANS = "array<string>", "array<bigint>", "array<boolean>"


def whole(c: Column, kind: T.DataType) -> Column:
    """A number floored; null where it isn't a safe integer."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_millis(c.cast("timestamp"))
    n = c.cast("bigint") if isinstance(kind, T.IntegralType) else F.when(F.abs(c) <= SAFE, F.floor(c)).cast("bigint")
    return F.when(F.abs(n) <= SAFE, n) if isinstance(kind, (T.LongType, T.DecimalType)) else n


def empty(kind: str) -> Column:
    return F.array().cast(kind)


class Fields:
    """Fields of a table under a configuration."""

    config: IndexConfig

    def names(self) -> list[str]:
        raise NotImplementedError

    def raw(self, name: str, kind: str) -> Column:
        """Values of one kind ('s', 'n', 'b') as an array that is never null."""
        raise NotImplementedError

    def scalar(self, name: str) -> Path | None:
        """The column of a typed field of single values, on which scans can filter by themselves."""
        return None

    def given(self, name: str) -> Column:
        """Whether the row has any value in the field."""
        raise NotImplementedError

    def output(self, name: str) -> Column:
        raise NotImplementedError

    def sort_keys(self, name: str) -> list[Column]:
        raise NotImplementedError

    def is_all(self, name: str | None) -> bool:
        return name is None or name in ALL_NAMES

    def terms(self, name: str | None) -> Column:
        if self.is_all(name):
            parts = [over(self.raw(f, "s"), None) for f in self.names() if self.config.of(f).in_all]
            strings = F.filter(F.concat(*parts), lambda x: x != "") if parts else empty(_STRINGS)
            return over(strings, self.config.catch_all.analyzer)
        c = self.config.of(name)
        return over(self.raw(name, "s"), c.analyzer) if c.searchable else empty(_STRINGS)

    def values(self, name: str | None, kind: str) -> Column:
        """Indexed numbers or booleans; the catch-all field leaves out 0 and false."""
        if self.is_all(name):
            parts = [self.raw(f, kind) for f in self.names() if self.config.of(f).in_all]
            if not parts:
                return empty(_LONGS if kind == "n" else _BOOLEANS)
            return F.filter(F.concat(*parts), (lambda x: x != 0) if kind == "n" else (lambda x: x))
        return self.raw(name, kind) if self.config.of(name).searchable else empty(_LONGS if kind == "n" else _BOOLEANS)

    def present(self, name: str) -> Column:
        """A stored field with any value, or a searchable one with at least one term."""
        if self.is_all(name):
            return (F.size(self.terms(None)) > 0) | (F.size(self.values(None, "n")) > 0) | (F.size(self.values(None, "b")) > 0)
        c = self.config.of(name)
        if c.stored:
            return self.given(name)
        if not c.searchable:
            return F.lit(False)
        if c.analyzer is None:
            return self.given(name) & ((F.size(self.raw(name, "s")) > 0) | (F.size(self.raw(name, "n")) > 0) | (F.size(self.raw(name, "b")) > 0))
        return (F.size(self.terms(name)) > 0) | (F.size(self.raw(name, "n")) > 0) | (F.size(self.raw(name, "b")) > 0)


class TypedFields(Fields):
    def __init__(self, schema: T.StructType, config: IndexConfig, hidden: tuple[str, ...] = ("_id",)):
        self.config = config
        self.paths = {k: p for k, p in paths(schema).items() if k not in hidden}

    def names(self) -> list[str]:
        return list(self.paths)

    def raw(self, name: str, kind: str) -> Column:
        p = self.paths.get(name)
        want = _STRINGS if kind == "s" else _LONGS if kind == "n" else _BOOLEANS
        if p is None:
            return empty(want)
        is_string, is_bool = isinstance(p.kind, T.StringType), isinstance(p.kind, T.BooleanType)
        if (kind == "s") != is_string or (kind == "b") != is_bool:
            return empty(want)
        if kind == "n" and not isinstance(p.kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            return empty(want)
        each = (lambda x: whole(x, p.kind)) if kind == "n" else (lambda x: x)
        if not p.many:
            v = each(p.column)
            return F.when(v.isNotNull(), F.array(v)).otherwise(empty(want))
        values = F.transform(p.column, each) if kind == "n" else p.column
        return F.coalesce(F.filter(values, lambda x: x.isNotNull()), empty(want))

    def scalar(self, name: str) -> Path | None:
        p = self.paths.get(name)
        return p if p and not p.many else None

    def given(self, name: str) -> Column:
        p = self.paths.get(name)
        if p is None:
            return F.lit(False)
        return p.column.isNotNull()

    def output(self, name: str) -> Column:
        p = self.paths.get(name)
        return (p.column if p else F.lit(None)).alias(name)

    def sort_keys(self, name: str) -> list[Column]:
        p = self.paths.get(name)
        if p is None:
            raise ValueError(f"no field {name} to sort by")
        c = F.get(p.column, F.lit(0)) if p.many else p.column
        if isinstance(p.kind, T.BooleanType):
            return [~c]  # true before false
        return [F.collate(c, COLLATION)] if isinstance(p.kind, T.StringType) else [c]


class OpenFields(Fields):
    """Fields of a map column, for documents without a schema. `known` are the names seen so far."""

    def __init__(self, known: list[str], config: IndexConfig):
        self.config, self.known = config, known

    def names(self) -> list[str]:
        return self.known

    def terms(self, name: str | None) -> Column:
        return over(F.filter(self._all("s"), lambda x: x != ""), self.config.catch_all.analyzer) if self.is_all(name) else super().terms(name)

    def values(self, name: str | None, kind: str) -> Column:
        return F.filter(self._all(kind), (lambda x: x != 0) if kind == "n" else (lambda x: x)) if self.is_all(name) else super().values(name, kind)

    def _all(self, kind: str) -> Column:
        """Values of all fields that count among the catch-all's, whatever names the document has."""
        named = self.config.fields
        out = [n for n, c in named.items() if not c.in_all]
        inside = [n for n, c in named.items() if c.in_all]
        entries = F.map_entries(F.col(FIELDS))
        if not self.config.default.in_all:
            entries = F.filter(entries, lambda e: e["key"].isin(inside))
        elif out:
            entries = F.filter(entries, lambda e: ~e["key"].isin(out))
        want = {"s": _STRINGS, "n": _LONGS, "b": _BOOLEANS}[kind]
        return F.coalesce(F.flatten(F.transform(entries, lambda e: F.coalesce(e["value"][kind], empty(want)))), empty(want))

    def raw(self, name: str, kind: str) -> Column:
        want = {"s": _STRINGS, "n": _LONGS, "b": _BOOLEANS}[kind]
        return F.coalesce(F.col(FIELDS)[name][kind], empty(want))

    def given(self, name: str) -> Column:
        return F.coalesce(F.map_contains_key(FIELDS, name), F.lit(False))

    def output(self, name: str) -> Column:
        """The value as JSON text: a list if there are several."""
        v = F.col(FIELDS)[name]
        parts = F.concat(*[F.transform(v[k], f) for k, f in (("s", lambda x: F.to_json(F.struct(x.alias("v")))), ("n", lambda x: F.to_json(F.struct(x.alias("v")))), ("b", lambda x: F.to_json(F.struct(x.alias("v")))))])
        texts = F.transform(parts, lambda x: F.substr(x, F.lit(6), F.length(x) - 6))
        return F.when(F.size(texts) == 1, texts[0]).when(F.size(texts) > 1, F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))).alias(name)

    def sort_keys(self, name: str) -> list[Column]:
        """Nothing, then booleans (true first), numbers, strings: as one rank and a key for each kind."""
        v = F.col(FIELDS)[name]
        first = lambda k: F.get(v[k], F.lit(0))
        rank = F.when(first("b").isNotNull(), 1).when(first("n").isNotNull(), 2).when(first("s").isNotNull(), 3)
        return [rank, ~first("b"), first("n"), F.collate(first("s"), COLLATION)]


def stored(config: IndexConfig, names: list[str]) -> list[str]:
    return [n for n in names if config.of(n).stored]


def check_sortable(config: IndexConfig, names: list[str], strict: bool) -> None:
    bad = [n for n in names if strict and not config.of(n).stored]
    if bad:
        raise ValueError(f"not stored, so no order: {', '.join(bad)}")


__all__ = ["Fields", "FieldConfig", "OpenFields", "TypedFields", "check_sortable", "stored"]
