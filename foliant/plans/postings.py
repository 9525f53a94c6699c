"""Queries over an inverted index: a table of (field, term, number, flag, _id).

This pays when terms are rare and documents large: the table is written packed, a value with a list of _ids, and sorted by field
and term, so a lookup reads few pages. In a conjunction the part with the fewest postings leads, and of the others only what the lead's ids have is looked at.
A negation needs all ids. The results equal the scan's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ALL_FIELD, FieldConfig, IndexConfig
from ..functions.analyzers import over
from ..functions.flatten import FIELDS
from ..operators import query as q
from ..operators.fields import ALL_NAMES, Fields, OpenFields
from ..shipping import ship

ROW = T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), T.StructField("number", T.LongType()), T.StructField("flag", T.BooleanType())])
KINDS = (("terms", "term", pa.string()), ("numbers", "number", pa.int64()), ("flags", "flag", pa.bool_()))
LAYOUT = 2  # of what `write` leaves; 1 had a row for each posting
SMALL = 1_000_000  # ids that are broadcast at most, 8 MB of them
BLOCK = 1 << 22  # values that a task packs at once, some 300 MB with what that needs
LONG = 1024  # lists of more ids than this are spread over the files, whatever their term


def _values(label: Column, terms: Column, numbers: Column, flags: Column, present: Column) -> Column:
    """Values of one field of one row, as they come."""
    return F.struct(label.alias("field"), terms.alias("terms"), numbers.alias("numbers"), flags.alias("flags"), F.coalesce(present, F.lit(False)).alias("present"))


def _rows(v: Column) -> Column:
    """Distinct values of one field of one row, and one row of nulls where the field is present."""
    row = lambda kind, x: F.struct(v["field"].alias("field"), *[(x if k == kind else F.lit(None)).cast(t).alias(k) for k, t in (("term", "string"), ("number", "bigint"), ("flag", "boolean"))])
    made = lambda kind: lambda x: row(kind, x)
    each = [F.transform(F.array_distinct(v[many]), made(k)) for many, k, _ in KINDS]
    return F.concat(*each, F.when(v["present"], F.array(row(None, None))).otherwise(F.array().cast(T.ArrayType(ROW))))


def values(df: DataFrame, fields: Fields, names: list[str] | None = None, with_all: bool = True) -> DataFrame:
    """For each row, its _id and the values of its fields."""
    names = [*(fields.names() if names is None else names), *([ALL_FIELD] if with_all else [])]
    every = [_values(F.lit(n), fields.terms(n), fields.values(n, "n"), fields.values(n, "b"), fields.present(n)) for n in names]
    return df.select("_id", F.array(*every).alias("_values"))


def open_values(df: DataFrame, config: IndexConfig) -> DataFrame:
    """The same for open documents, whatever names their fields have: a document's own are gone through, not those of all."""

    def kind(e: Column, kind: str) -> Column:
        return F.coalesce(e["value"][kind], F.array().cast({"s": "array<string>", "n": "array<bigint>", "b": "array<boolean>"}[kind]))

    def of(e: Column, c: FieldConfig) -> Column:
        none = lambda t: F.array().cast(f"array<{t}>")
        s, n, b = (kind(e, k) for k in "snb")
        if not c.searchable:
            return _values(e["key"], none("string"), none("bigint"), none("boolean"), F.lit(c.stored))
        terms = over(s, c.analyzer)
        any_ = F.lit(True) if c.stored else (F.size(terms) > 0) | (F.size(n) > 0) | (F.size(b) > 0)
        return _values(e["key"], terms, n, b, any_)

    def one(e: Column) -> Column:
        out = of(e, config.default)
        for name in config.fields:
            out = F.when(e["key"] == name, of(e, config.fields[name])).otherwise(out)
        return out

    fields = OpenFields([], config)
    own = F.transform(F.map_entries(FIELDS), one)
    everything = _values(F.lit(ALL_FIELD), fields.terms(None), fields.values(None, "n"), fields.values(None, "b"), fields.present(ALL_FIELD))
    return df.select("_id", F.concat(own, F.array(everything)).alias("_values"))


def postings(values: DataFrame) -> DataFrame:
    """One row for each distinct term, number or flag of each field of each row, and one of nulls where the field is present."""
    return values.select("_id", F.explode("_values").alias("v")).select("_id", F.explode(_rows(F.col("v"))).alias("p")).select("p.*", "_id")


def stored(key: T.DataType) -> T.StructType:
    """What `write` leaves: each value of a field with the _ids of rows that have it, in as many lists as there were blocks of them."""
    return T.StructType([*ROW.fields, T.StructField("_ids", T.ArrayType(key))])


def write(values: DataFrame, path: str) -> None:
    """Sorted by field and term, so that readers skip what they don't look for; the _ids of a term of very many rows are spread.

    Rows are packed where they are read, in one pass, so that what is shuffled and sorted are lists and not postings.
    """
    ship(values.sparkSession)
    packed = values.mapInArrow(_pack, stored(values.schema["_id"].dataType))
    spread = F.when(F.size("_ids") > LONG, F.hash(F.get("_ids", F.lit(0)))).otherwise(F.lit(0))
    packed.repartition("field", "term", "number", "flag", spread).sortWithinPartitions("field", "term", "number").write.parquet(path)


def unpacked(written: DataFrame) -> DataFrame:
    """Written postings with a row for each; what is asked of the values is asked before the lists are taken apart."""
    return written.select(*ROW.names, F.explode("_ids").alias("_id"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_id and values, packed by field and value in blocks of about BLOCK values."""
    held, n = [], 0
    for b in batches:
        at = 0
        sizes = b.num_rows + _count(b)
        step = max(1, b.num_rows * BLOCK // max(sizes, 1))
        while at < b.num_rows:
            part = b.slice(at, step)
            at += step
            held.append(part)
            n += part.num_rows + _count(part)
            if n >= BLOCK:
                yield from _block(held)
                held, n = [], 0
    if held:
        yield from _block(held)


def _count(b: pa.RecordBatch) -> int:
    each = b.column("_values").flatten()
    return sum(len(pc.struct_field(each, many).flatten()) for many, _, _ in KINDS)


def _block(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, lists = (_whole(table.column(n)) for n in ("_id", "_values"))
    each = lists.flatten()
    row = np.repeat(np.arange(len(ids), dtype=np.int32), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    named = pc.struct_field(each, "field").dictionary_encode()
    names, name = named.dictionary, named.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def lists_of(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Distinct keys and the _ids of their rows, each once and in order; rows ascend among equal keys after a stable sort."""
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        kept = new.copy()
        kept[1:] |= at[1:] != at[:-1]
        key, at, new = key[kept], at[kept], new[kept]
        starts = np.append(np.flatnonzero(new), len(key)).astype(np.int32)
        return key[new], pa.ListArray.from_arrays(pa.array(starts), ids.take(pa.array(at)))

    def batch(fields: np.ndarray, have: str | None, found: pa.Array | None, packed: pa.Array) -> pa.RecordBatch:
        n = len(packed)
        columns = [names.take(pa.array(fields)), *[found if k == have else pa.nulls(n, t) for _, k, t in KINDS], packed]
        return pa.RecordBatch.from_arrays(columns, names=[*ROW.names, "_ids"])

    for many, k, t in KINDS:
        many = pc.struct_field(each, many)
        owner = np.repeat(np.arange(len(each), dtype=np.int32), pc.fill_null(pc.list_value_length(many), 0).to_numpy(zero_copy_only=False))
        found = many.flatten()
        if found.null_count:
            there = found.is_valid()
            owner, found = owner[there.to_numpy(zero_copy_only=False)], found.filter(there)
        if len(found):
            coded = found.dictionary_encode()
            size = len(coded.dictionary)
            keys, packed = lists_of(name[owner] * size + coded.indices.to_numpy(zero_copy_only=False), row[owner])
            yield batch(keys // size, k, coded.dictionary.take(pa.array(keys % size)).cast(t), packed)
    there = pc.struct_field(each, "present").to_numpy(zero_copy_only=False).astype(bool)
    if there.any():
        keys, packed = lists_of(name[there], row[there])
        yield batch(keys, None, None, packed)


def _whole(c: pa.ChunkedArray) -> pa.Array:
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def leading(query: q.Query, index: DataFrame, universe: DataFrame, most: int | None = None) -> DataFrame | None:
    """_ids of the matching rows, found from the postings; None where these can't answer, or let more than `most` rows match.

    The leaves' postings are counted first, a read of a few pages each. What a conjunction can match is bounded by its
    least part, a disjunction by the sum of its parts. The least part of a conjunction leads.
    """
    query = q.simplify(query)
    leaves = list(dict.fromkeys(_leaves(query)))
    if not leaves or any(isinstance(x, q.Contains) for x in leaves):
        return None
    tests = [_test(x) for x in leaves]
    counted = index.filter(reduce(or_, tests)).agg(*[F.count_if(t).alias(f"c{k}") for k, t in enumerate(tests)]).first()
    sizes = dict(zip(leaves, counted))
    bound = _bound(query, sizes)
    if bound is None or (most is not None and bound > most):
        return None
    lead = min((x for x in query.parts if _bound(x, sizes) is not None), key=lambda x: _bound(x, sizes)) if isinstance(query, q.And) else None
    if lead is None:
        return matching(query, index, universe)
    first = matching(lead, index, universe)
    first = F.broadcast(first) if bound <= SMALL else first
    rest = [x for x in query.parts if x != lead]
    # what the lead doesn't have need not be looked at, and what it has is the universe of the rest
    return matching(q.And(tuple(rest)), index.join(first, "_id", "left_semi"), first) if rest else first


def _bound(x: q.Query, sizes: dict[q.Query, int]) -> int | None:
    """The most rows that can match; None if there is no telling."""
    if isinstance(x, (q.And, q.Or)):
        parts = [_bound(p, sizes) for p in x.parts]
        if isinstance(x, q.And):
            return min((b for b in parts if b is not None), default=None)
        return None if None in parts else sum(parts)
    if isinstance(x, q.Named):
        return _bound(x.part, sizes)
    if isinstance(x, q.Nothing):
        return 0
    return sizes.get(x)


def matching(query: q.Query, index: DataFrame, universe: DataFrame) -> DataFrame:
    """Distinct _id of the matching rows; universe has every _id.

    One pass over the rows of all the terms that the query names, one aggregation by _id that says which of them each
    id has, and the query itself as a condition on these flags. Ids without any of them are only looked at if they could match.
    """
    query = q.simplify(query)
    leaves = list(dict.fromkeys(_leaves(query)))
    flag = {leaf: f"p{k}" for k, leaf in enumerate(leaves)}
    if not leaves:
        return universe.select("_id").filter(_holds(query, {}))
    tests = [_test(leaf) for leaf in leaves]
    rows = index.filter(reduce(or_, tests)).select("_id", *[F.coalesce(t, F.lit(False)).alias(flag[leaf]) for t, leaf in zip(tests, leaves)])
    found = rows.groupBy("_id").agg(*[F.bool_or(n).alias(n) for n in flag.values()])
    if not _empty_matches(query):
        return found.filter(_holds(query, {leaf: F.col(n) for leaf, n in flag.items()})).select("_id")
    every = universe.select("_id").join(found, "_id", "left")
    return every.filter(_holds(query, {leaf: F.coalesce(F.col(n), F.lit(False)) for leaf, n in flag.items()})).select("_id")


def _leaves(x: q.Query) -> list[q.Query]:
    if isinstance(x, (q.And, q.Or)):
        return [y for p in x.parts for y in _leaves(p)]
    if isinstance(x, (q.Not, q.Named)):
        return _leaves(x.part)
    return [] if isinstance(x, (q.All, q.Nothing)) else [x]


def _holds(x: q.Query, flags: dict[q.Query, Column]) -> Column:
    if isinstance(x, q.And):
        return reduce(and_, [_holds(p, flags) for p in x.parts])
    if isinstance(x, q.Or):
        return reduce(or_, [_holds(p, flags) for p in x.parts])
    if isinstance(x, q.Not):
        return ~_holds(x.part, flags)
    if isinstance(x, q.Named):
        return _holds(x.part, flags)
    return F.lit(isinstance(x, q.All)) if isinstance(x, (q.All, q.Nothing)) else flags[x]


def _empty_matches(x: q.Query) -> bool:
    """Whether a row with none of the terms matches."""
    if isinstance(x, q.And):
        return all(map(_empty_matches, x.parts))
    if isinstance(x, q.Or):
        return any(map(_empty_matches, x.parts))
    if isinstance(x, q.Not):
        return not _empty_matches(x.part)
    return _empty_matches(x.part) if isinstance(x, q.Named) else isinstance(x, q.All)


def _test(x: q.Query) -> Column:
    """Which rows of the index a leaf looks for; null, as false, for some others. In a form that file readers can skip by."""
    name = ALL_FIELD if x.field is None or x.field in ALL_NAMES else x.field
    if isinstance(x, q.HasToken):
        kinds = {"term": [v for v in x.values if isinstance(v, str)], "flag": [v for v in x.values if isinstance(v, bool)]}
        c = reduce(or_, [F.col(k).isin(v) for k, v in kinds.items() if v], F.lit(False))
    elif isinstance(x, q.HasNumber):
        c = F.col("number") == x.value
    elif isinstance(x, (q.InRange, q.TokenRange)):
        v = F.col("number" if isinstance(x, q.InRange) else "term")
        c = reduce(and_, [v.isNotNull()] + ([v >= x.low] if x.low is not None else []) + ([v <= x.high if isinstance(x, q.InRange) else v < x.high] if x.high is not None else []))
    elif isinstance(x, q.Present):
        c = F.col("term").isNull() & F.col("number").isNull() & F.col("flag").isNull()
    else:
        raise ValueError(f"postings can't answer {type(x).__name__}; scan instead")
    return (F.col("field") == name) & c


def vocabulary(df: DataFrame, fields: Fields, name: str) -> DataFrame:
    """Each term of a field and the number of rows that hold it."""
    return df.select(F.explode(F.array_distinct(fields.terms(name))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
