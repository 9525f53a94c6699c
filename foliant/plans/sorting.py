"""Orders over fields: nothing first, true before false, numbers, strings by collation; `_id` decides between equals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.fields import Fields, check_sortable

IMPLICIT_LIMIT = 1000


@dataclass(frozen=True)
class By:
    field: str
    descending: bool = False


Sort = list[By | str]


def clauses(sort: Sort) -> list[By]:
    return [By(s) if isinstance(s, str) else s for s in sort]


def asc(field: str) -> By:
    return By(field)


def desc(field: str) -> By:
    return By(field, True)


def keys(sort: Sort, fields: Fields, strict: bool = False) -> list[tuple[Column, bool]]:
    """Key expressions and whether each descends; `strict` refuses fields that aren't stored."""
    by = clauses(sort)
    check_sortable(fields.config, [b.field for b in by], strict)
    return [(k, b.descending) for b in by for k in ([F.col("_id")] if b.field == "_id" else fields.sort_keys(b.field))]


def order(sort: Sort, fields: Fields, strict: bool = False) -> list[Column]:
    return [k.desc_nulls_last() if down else k.asc_nulls_first() for k, down in keys(sort, fields, strict)] + [F.col("_id").asc()]
