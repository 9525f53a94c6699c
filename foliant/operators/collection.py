"""A queryable table: rows with a distinct `_id`, fields under a configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IndexConfig
from ..functions.flatten import FIELDS
from ..plans import postings as p
from ..plans.scan import condition
from ..plans.sorting import IMPLICIT_LIMIT, Sort, order
from . import aggregate as a
from . import query as q
from .fields import Fields, OpenFields, TypedFields, stored


class Collection:
    """`strict` refuses to sort by or to project fields that the configuration doesn't store."""

    def __init__(self, df: DataFrame, fields: Fields, strict: bool = False, filters: dict[str, q.Query] | None = None):
        self.df, self.fields, self.strict = df, fields, strict
        self.filters = filters if filters is not None else {}
        self.held: dict[str, tuple[q.Query, DataFrame]] = {}

    @classmethod
    def of(cls, df: DataFrame, key: str | Column, config: IndexConfig | None = None, strict: bool = False) -> Collection:
        """A typed table; `key` gives each row's _id. Fields with a generator are added as columns."""
        config = config or IndexConfig()
        for name, c in config.fields.items():
            if c.generator:
                df = df.withColumn(name, c.generator())
        df = df.withColumn("_id", F.col(key) if isinstance(key, str) else key)
        return cls(df, TypedFields(df.schema, config), strict)

    def register(self, name: str, query: q.Query) -> q.Query:
        """A named filter, to be used in any query."""
        self.filters[name] = query
        return q.Named(name, query)

    def filtered(self, query: q.Query) -> DataFrame:
        """Matching rows. Held filters that the query demands, or rules out, are joined by their _ids and not computed again."""
        query = q.simplify(query)
        rows, rest = self.df, []
        for part in query.parts if isinstance(query, q.And) else [query]:
            inner = part.part if isinstance(part, q.Not) else part
            known, ids = self.held.get(inner.name, (None, None)) if isinstance(inner, q.Named) else (None, None)
            if ids is not None and known == inner.part:
                rows = rows.join(ids, "_id", "left_semi" if part is inner else "left_anti")
            else:
                rest.append(part)
        return rows.filter(condition(q.and_(*rest), self.fields))

    def hold(self, name: str, path: str) -> None:
        """Writes the _ids of a registered filter once; queries that name it then read these."""
        self.filtered(self.filters[name]).select("_id").write.mode("ignore").parquet(path)
        ids = self.df.sparkSession.read.schema(self.df.select("_id").schema).parquet(path)
        self.held[name] = (q.simplify(self.filters[name]), ids)

    def query(self, query: q.Query, sort: Sort | None = None, limit: int | None = None, projection: list[str] | None = None) -> DataFrame:
        """Matching rows as _id and the projection; a sort without a limit gives IMPLICIT_LIMIT rows."""
        rows = self.filtered(query)
        if sort:
            rows = rows.orderBy(*order(sort, self.fields, self.strict)).limit(limit or IMPLICIT_LIMIT)
        elif limit and limit > 0:
            rows = rows.limit(limit)
        return rows.select(F.col("_id"), *self.projected(projection))

    def projected(self, projection: list[str] | None) -> list[Column]:
        if projection is not None:
            off = [n for n in projection if self.strict and not self.fields.config.of(n).stored]
            return [F.lit(None).alias(n) if n in off else self.fields.output(n) for n in projection if n != "_id"]
        if not self.fields.config.keep_source:
            return [self.fields.output(n) for n in stored(self.fields.config, self.fields.names())]
        if isinstance(self.fields, OpenFields):
            return [F.col("_source")]
        return [F.struct(*[F.col(f"`{c}`") for c in self.df.columns if c not in ("_id", FIELDS)]).alias("_source")]

    def document(self, key: int, projection: list[str] | None = None) -> DataFrame:
        return self.df.filter(F.col("_id") == key).select("_id", *self.projected(projection))

    def aggregate(self, query: q.Query, parts: list) -> list[DataFrame]:
        return a.aggregate(self.filtered(query), self.fields, parts)

    def size(self) -> int:
        return self.df.count()

    def names(self) -> list[str]:
        return sorted(set(self.fields.names()) | set(self.fields.config.fields))

    def terms(self, name: str, kind: str = "s") -> DataFrame:
        """Distinct terms of a field in order; its numbers with kind 'n', its booleans with kind 'b'."""
        if kind == "s":
            return self.vocabulary(name).select("term").orderBy("term")
        return self.df.select(F.explode(self.fields.values(name, kind)).alias("term")).distinct().orderBy("term")

    def vocabulary(self, name: str) -> DataFrame:
        return p.vocabulary(self.df, self.fields, name)

    def postings(self, names: list[str] | None = None, with_all: bool = True) -> DataFrame:
        return p.postings(self.values(names, with_all))

    def values(self, names: list[str] | None = None, with_all: bool = True) -> DataFrame:
        """What `plans.postings.write` makes a table of postings from."""
        return p.values(self.df, self.fields, names, with_all)

    def query_postings(self, query: q.Query, index: DataFrame, projection: list[str] | None = None) -> DataFrame:
        """As `query`, by way of a table of postings."""
        ids = p.leading(query, index, self.df)
        ids = p.matching(query, index, self.df) if ids is None else ids
        return self.df.join(ids, "_id", "left_semi").select("_id", *self.projected(projection))

    def kept(self, name: str, path: str) -> Collection:
        """The rows of a registered filter, written once; other queries then start from them."""
        self.filtered(self.filters[name]).write.mode("ignore").parquet(path)
        rows = self.df.sparkSession.read.schema(self.df.schema).parquet(path)
        return Collection(rows, self.fields, self.strict, self.filters)
