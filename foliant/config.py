"""How fields are indexed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import IntFlag

from pyspark.sql import Column

from .functions.analyzers import Analyzer, standard, stopped

ALL_FIELD = "_all"


class Flag(IntFlag):
    IGNORED = 0
    SEARCHABLE = 1
    STORED = 2
    SORTED = 4


@dataclass(frozen=True)
class FieldConfig:
    """`analyzer` None keeps each string as one case-sensitive term; `generator` computes the field from the row's columns."""

    flags: Flag = Flag.SEARCHABLE
    in_all: bool = True
    analyzer: Analyzer | None = None
    generator: Callable[[], Column] | None = None

    @property
    def searchable(self) -> bool:
        return bool(self.flags & Flag.SEARCHABLE)

    @property
    def stored(self) -> bool:
        return bool(self.flags & (Flag.STORED | Flag.SORTED))


@dataclass(frozen=True)
class IndexConfig:
    """`fields` by name; names not in it are treated as `default` says once they are seen in a document."""

    fields: dict[str, FieldConfig] = field(default_factory=dict)
    default: FieldConfig = FieldConfig(analyzer=standard)
    catch_all: FieldConfig = FieldConfig(analyzer=stopped(standard))
    keep_source: bool = True

    def __post_init__(self) -> None:
        if self.catch_all.flags != Flag.SEARCHABLE:
            raise ValueError(f"{ALL_FIELD} can only be searchable")

    def of(self, name: str) -> FieldConfig:
        return self.catch_all if name == ALL_FIELD else self.fields.get(name, self.default)
