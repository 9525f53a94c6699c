"""Queries over what is there, what will come, or both.

A stream reads the files of an index's documents; each commit's number tells what belongs to the snapshot, so nothing is lost
or seen twice where the one ends and the other begins. Deletions don't reach a live stream.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.collection import Collection
from ..operators.fields import OpenFields
from ..operators.query import Query
from ..plans.sorting import Sort
from ..sources.store import DOCS, Index


class Mode(Enum):
    CURRENT = "current"
    FUTURE = "future"
    BOTH = "current and future"


@dataclass(frozen=True)
class Live:
    """The rows there are (None if not asked for) and the stream of those to come (None if not asked for)."""

    current: DataFrame | None
    future: DataFrame | None
    commit: int


def query(index: Index, query: Query, sort: Sort | None = None, limit: int | None = None, projection: list[str] | None = None, mode: Mode = Mode.CURRENT, commit: int | None = None) -> Live:
    """With BOTH, a sort orders and limits the rows there are; those to come are neither sorted nor limited then.

    Without a sort, BOTH is one stream from the first commit on, and a limit bounds the whole of it.
    """
    if mode is Mode.FUTURE and sort:
        raise ValueError("rows to come can't be sorted")
    log = index.commits()
    upto = (log[-1]["commit_id"] if log else -1) if commit is None else commit
    if mode is Mode.CURRENT:
        return Live(index.snapshot(upto).query(query, sort, limit, projection), None, upto)
    docs = index.spark.readStream.schema(DOCS).parquet(f"{index.path}/docs")
    known = sorted(set(index.config.fields).union(*[c["names"] for c in log]))
    if mode is Mode.BOTH and not sort:
        rows = Collection(docs.drop("commit_id"), OpenFields(known, index.config), True)
        return Live(None, rows.query(query, None, limit, projection), upto)
    later = Collection(docs.filter(F.col("commit_id") > upto).drop("commit_id"), OpenFields(known, index.config), True)
    stream = later.query(query, None, limit if mode is Mode.FUTURE else None, projection)
    return Live(index.snapshot(upto).query(query, sort, limit, projection) if mode is Mode.BOTH else None, stream, upto)


def counts(index: Index, query: Query, field: str) -> DataFrame:
    """A stream of running counts by the first value of a field, to be written in complete or update mode."""
    docs = index.spark.readStream.schema(DOCS).parquet(f"{index.path}/docs").drop("commit_id")
    fields = OpenFields([field], index.config)
    rows = Collection(docs, fields).filtered(query)
    return rows.groupBy(F.coalesce(F.get(fields.raw(field, "s"), F.lit(0)), F.get(fields.raw(field, "n"), F.lit(0)).cast("string")).alias(field)).count()
