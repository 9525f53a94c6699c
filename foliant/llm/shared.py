"""What several operators share: written intermediate tables, words of whole texts, bounded samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.folder import own_folder

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SPACE = re.compile(r"\s")
_LONGEST_CACHED = 64
PIECE = 1 << 20
CHUNK_CHARS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder of its own; on a cluster that is an error,
    since executors could not read each other's files there.
    """
    return own_folder(spark)


def spread(df: DataFrame) -> DataFrame:
    """df in at least half as many partitions as there are cores; a table in a few small files is dealt out first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # it has partitions of its own, and counting them would run it
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


class Scratch:
    """Tables written once and read again, so that a lost executor costs a task and no lineage is repeated."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, shared_folder(spark), 0
        self.at: dict[int, tuple[DataFrame, str]] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(table)] = (table, path)
        return table

    def remove(self, *tables: DataFrame) -> None:
        """Deletes tables of this scratch that nothing will read again."""
        for t in tables:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at.pop(id(t))[1])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word(raw: str) -> str:
    """The lower-case word in a piece of text between white space; '' if it is punctuation only."""
    return _EDGES.sub("", raw).lower()


def hash32(s: str) -> int:
    return xxhash.xxh32_intdigest(s.encode("utf-8", "replace"))


class Words(dict):
    """Maps what stands between white space to a number, worked out once per distinct string."""

    def __init__(self, of: Callable[[str], int], limit: int = 300_000):
        super().__init__()
        self.of, self.limit = of, limit

    def __missing__(self, raw: str) -> int:
        value = self.of(raw)
        if len(raw) <= _LONGEST_CACHED:
            if len(self) >= self.limit:
                self.clear()
            self[raw] = value
        return value


def pieces(text: str) -> Iterator[str]:
    """A text in parts of about a megabyte, cut at white space, so that no list of all its words is ever built."""
    at = 0
    while len(text) - at > PIECE:
        m = _SPACE.search(text, at + PIECE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


def numbers(text: str, words: Words, dtype=np.uint32) -> np.ndarray:
    """One number for each word of the whole text, punctuation (0) left out."""
    parts = []
    for p in pieces(text):
        raw = p.split()
        parts.append(np.fromiter(map(words.__getitem__, raw), dtype, len(raw)))
    a = parts[0] if len(parts) == 1 else np.concatenate(parts)
    return a[a != 0] if len(a) and not a.all() else a


_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_PLACE = np.random.default_rng(41).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)


def solitary(b: np.ndarray) -> np.ndarray:
    """Where characters of scripts without spaces start in UTF-8."""
    at = np.flatnonzero(b >= 0xE0)
    if not len(at):
        return at
    lead, then = b[at], b[np.minimum(at + 1, len(b) - 1)]
    wide = (lead >= 0xE3) & (lead <= 0xE9) | (lead == 0xF0) & (then >= 0xA0) & (then <= 0xBF)
    thai = (lead == 0xE0) & (then >= 0xB8) & (then <= 0xBB)
    khmer = (lead == 0xE1) & ((then <= 0x82) | (then == 0x9E) | (then == 0x9F))
    return at[wide | thai | khmer | (lead == 0xEF) & (then >= 0xA4) & (then <= 0xAB)]


def cut_alone(b: np.ndarray, first: np.ndarray, end: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and lengths of words, the runs being cut before and after each solitary character."""
    after = alone + np.where(b[alone] >= 0xF0, 4, 3)
    cuts = np.unique(np.concatenate([first, alone, after]))
    run = np.searchsorted(first, cuts, "right") - 1
    inside = (run >= 0) & (cuts < end[run])
    cuts, run = cuts[inside], run[inside]
    return cuts, np.minimum(np.append(cuts[1:], end[-1]), end[run]) - cuts


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """32 bits of every lower-case word of the texts, and where each text's words start (one more entry: the end).

    A word is a run of ASCII letters, digits and characters beyond ASCII; in scripts that are written without spaces
    (Chinese, Japanese, Thai, Lao, Burmese, Khmer) each character is one. All is done on the bytes at once, without an
    object for each word, long texts in pieces.
    """
    parts = [(k, p.lower().encode("utf-8", "replace")) for k, t in enumerate(texts) if t for p in pieces(t)]
    hashes, ends = [], np.zeros(len(texts) + 1, np.int64)
    at = 0
    while at < len(parts):
        stop, size = at, 0
        while stop < len(parts) and (stop == at or size + len(parts[stop][1]) <= PIECE):
            size += len(parts[stop][1]) + 1
            stop += 1
        b = np.frombuffer(b"\n".join([p for _, p in parts[at:stop]]) + b"\n", np.uint8)
        inside = _INSIDE[b]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(b) and inside[0]:
            edge = np.append(0, edge)
        first, length = edge[::2], edge[1::2] - edge[::2]
        if len(alone := solitary(b)):
            first, length = cut_alone(b, first, first + length, alone)
        start = np.cumsum(length) - length
        within = np.arange(length.sum()) - np.repeat(start, length)
        h = np.add.reduceat(b[inside].astype(np.uint64) * _PLACE[within & 4095], start) if len(start) else np.zeros(0, np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        hashes.append((h >> np.uint64(32)).astype(np.uint32))
        offsets = np.cumsum([0] + [len(p) + 1 for _, p in parts[at:stop]])
        np.add.at(ends, np.array([k for k, _ in parts[at:stop]]) + 1, np.diff(np.searchsorted(first, offsets)))
        at = stop
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)), np.cumsum(ends)


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about a megabyte of text each, at least one row."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > CHUNK_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def ragged(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays end to end, and where each starts (one more entry: the end)."""
    starts = np.zeros(len(arrays) + 1, np.int64)
    np.cumsum([len(a) for a in arrays], out=starts[1:])
    return (np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)), starts


def order_hash(*columns: Column | str, seed: int = 0) -> Column:
    """A seeded pseudo-random order of rows."""
    return F.xxhash64(F.lit(seed), *columns)


def bounded_sample(rows: DataFrame, strata: list[str], key: str, per_stratum: int, seed: int = 0) -> DataFrame:
    """At most per_stratum keys of each stratum, those of least seeded hash; ties by key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*strata).orderBy(order_hash(key, seed=seed), key)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= per_stratum).drop("_rank")
