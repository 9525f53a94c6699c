"""Nested documents as fields with dotted names.

Typed tables: `paths` reads the schema and gives an expression for each field, so that only the columns a query names are read.
Open documents (JSON of any form): `flatten` works on one document, `open_fields` on a column of JSON texts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

SAFE = (1 << 53) - 1
FIELDS = "_fields"
MADE = "_made"
VALUES = T.StructType([T.StructField("s", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.LongType())), T.StructField("b", T.ArrayType(T.BooleanType()))])


@dataclass(frozen=True)
class Path:
    """A field of a typed table: its expression, its element type, and whether it is an array."""

    name: str
    column: Column
    kind: T.DataType
    many: bool


def member(name: str):
    return lambda x: x[name]


def paths(schema: T.StructType) -> dict[str, Path]:
    """Fields of a schema; arrays of structs give arrays of their members, nulls left out. Binary values and maps are kept but have no fields."""
    out: dict[str, Path] = {}

    def walk(name: str, column: Column, kind: T.DataType, many: bool) -> None:
        if isinstance(kind, T.StructType):
            for f in kind:
                inner = F.transform(column, member(f.name)) if many else column[f.name]
                walk(f"{name}.{f.name}" if name else f.name, inner, f.dataType, many)
        elif isinstance(kind, T.ArrayType):
            walk(name, F.flatten(F.filter(column, lambda x: x.isNotNull())) if many else column, kind.elementType, True)
        elif not isinstance(kind, (T.MapType, T.BinaryType, T.VariantType)):
            out[name] = Path(name, F.filter(column, lambda x: x.isNotNull()) if many else column, kind, many)

    for f in schema:
        walk(f.name, F.col(f"`{f.name}`"), f.dataType, False)
    return out


def value(x: Any) -> Any:
    """A plain value as it is kept, None if it isn't one."""
    if isinstance(x, (str, bool)):
        return x
    if isinstance(x, (int, float)) and (isinstance(x, int) or math.isfinite(x)):
        n = math.floor(x)
        return n if abs(n) <= SAFE else None
    return None


def flatten(doc: dict[str, Any]) -> dict[str, Any]:
    """Dotted names to values or lists of values; numbers are floored, those beyond 2**53 and nulls are left out.

    An array of plain values is a list; of an array with documents or arrays in it, these are flattened and merged under
    the array's name (an inner array's places become names), and its plain values stay values of the array's own name.
    """
    if not any(isinstance(x, (dict, list)) or not isinstance(k, str) for k, x in doc.items()):
        return {k: v for k, x in doc.items() if (v := value(x)) is not None}
    out: dict[str, Any] = {}

    def put(name: str, x: Any) -> None:
        if name not in out:
            out[name] = x
        else:
            have = out[name] if isinstance(out[name], list) else [out[name]]
            out[name] = have + (x if isinstance(x, list) else [x])

    def walk(name: str, x: Any) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk(f"{name}.{k}" if name else str(k), v)
        elif isinstance(x, list):
            plain = [v for v in map(value, x) if v is not None]
            if plain or not x:
                put(name, plain)
            for v in x:
                if isinstance(v, dict):
                    walk(name, v)
                elif isinstance(v, list):
                    for k, w in enumerate(v):
                        walk(f"{name}.{k}", w)
        elif (v := value(x)) is not None:
            put(name, v)

    walk("", doc)
    return out


def mapped(docs: list[dict[str, Any]]) -> pa.Array:
    """Each flattened document as a map from its names to their values by kind."""
    names: list[str] = []
    ends, of_s, of_n, of_b = [0], [0], [0], [0]
    s: list[str] = []
    n: list[int] = []
    b: list[bool] = []
    for doc in docs:
        for name, x in doc.items():
            names.append(name)
            for v in x if isinstance(x, list) else (x,):
                (s if isinstance(v, str) else b if isinstance(v, bool) else n).append(v)
            of_s.append(len(s))
            of_n.append(len(n))
            of_b.append(len(b))
        ends.append(len(names))
    each = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, t)) for o, v, t in ((of_s, s, pa.string()), (of_n, n, pa.int64()), (of_b, b, pa.bool_()))]
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.StructArray.from_arrays(each, names=["s", "n", "b"]))


def open_fields(df: DataFrame, source: str = "_source") -> DataFrame:
    """df with a map from field names to values by kind. A text that is not a JSON object counts as an empty document.

    If there is a column of computed fields (MADE, JSON objects), these replace the document's own of the same name.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.drop(FIELDS).schema.fields, T.StructField(FIELDS, T.MapType(T.StringType(), VALUES))])
    names = df.drop(FIELDS).columns
    at, made = names.index(source), names.index(MADE) if MADE in names else None
    def flat(text: str | None) -> dict[str, Any]:
        try:
            doc = json.loads(text) if text else {}
            return flatten(doc) if isinstance(doc, dict) else {}
        except (ValueError, RecursionError):
            return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = [flat(x) for x in b.column(at).to_pylist()]
            if made is not None:
                docs = [{**doc, **(flat(more) if more else {})} for doc, more in zip(docs, b.column(made).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, mapped(docs)], names=[*b.schema.names, FIELDS])

    return df.drop(FIELDS).mapInArrow(run, schema)
