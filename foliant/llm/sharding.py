"""Shuffling into shards in two passes, as an external shuffle does.

The first pass scatters records uniformly, by a seeded hash of the whole record, into buckets sized for memory; the second
reads each bucket, shuffles it by Fisher-Yates and gives it out as a shard. A bucket's rows are first put in the order of
doc_id and record hash, so the result depends on rows and seed alone, not on partitions or retries.

How many buckets there are follows from the bytes of all columns. A bucket is read by one task as a whole; the first pass
makes them even. Up to PARTS buckets are a partition each; beyond, a partition holds several, which Spark sorts by
bucket (spilling as it must) and the task takes one at a time, so their number can grow without end.

Defined results: `shard` (from 0) and `position` (from 0 within the shard) are added and replace columns of these names.
Null doc_ids come first in the order before the shuffle; null and empty texts are records like others. Rows that agree in
every column land in one bucket, where it doesn't matter which is which. A record longer than a bucket makes its bucket
that much larger. An empty table gives an empty result. Maps and variants, at any depth, count as their JSON.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, in_arrow, table

BUCKET_BYTES = 32 << 20
PARTS = 16_384
SEED = 97
ADDED = ("shard", "position")
HASH = "__record_hash__"
OUT = 1000  # rows given back at once


def flat(kind: T.DataType) -> bool:
    """Whether there is no map or variant in it."""
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return flat(kind.elementType)
    return all(flat(f.dataType) for f in kind) if isinstance(kind, T.StructType) else True


def record_bytes(documents: DataFrame) -> int:
    """Bytes of all strings and nested values, and 64 for the rest of each row."""
    size = F.lit(64).cast("long")
    for f in documents.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size += F.coalesce(F.octet_length(c).cast("long"), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            size += F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("c")))).cast("long"), F.lit(0))
    return documents.agg(F.sum(size)).first()[0] or 0


def fisher_yates(n: int, seed: int, shard: int) -> np.ndarray:
    """A permutation of range(n): from the end, each place is swapped with one not beyond it."""
    r = np.random.default_rng([seed, shard])
    pick = (r.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    a = list(range(n))
    for i in range(n - 1, 0, -1):
        j = pick[i]
        a[i], a[j] = a[j], a[i]
    return np.array(a, np.int64)


def record_hash(documents: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") if flat(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`").alias("c"))) for f in documents.schema])


def shuffle(documents: DataFrame, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, parts: int = PARTS) -> DataFrame:
    """All rows and columns of documents, with shard and position. Partitions hold whole shards, one each up to `parts` of them."""
    documents = documents.drop(*ADDED)
    shards = max(1, math.ceil(record_bytes(documents) / bucket_bytes))
    name = HASH
    while name in documents.columns:
        name += "_"
    scattered = documents.withColumn(name, record_hash(documents, seed)).withColumn("shard", F.pmod(F.col(name), F.lit(shards)).cast("int"))
    schema = T.StructType([*documents.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("position", T.LongType())])
    buckets = scattered.repartitionById(min(shards, parts), F.pmod(F.col("shard"), F.lit(min(shards, parts))))
    return in_arrow(buckets if shards <= parts else buckets.sortWithinPartitions("shard"), shuffler(seed, name), schema)


def shuffler(seed: int, name: str):
    def shuffled(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        held.clear()
        keys = [(k, "ascending") for k in ("doc_id", name) if k in t.column_names]
        order = pa.compute.sort_indices(t.select([k for k, _ in keys]), sort_keys=keys, null_placement="at_start")
        order = order.take(pa.array(fisher_yates(t.num_rows, seed, t.column("shard")[0].as_py())))
        for at in range(0, t.num_rows, OUT):
            part = t.take(order.slice(at, OUT)).drop_columns([name])
            yield from part.append_column("position", pa.array(np.arange(at, at + part.num_rows))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            shard = b.column(b.schema.get_field_index("shard")).to_numpy()
            for low, high in zip(at := np.append(0, 1 + np.flatnonzero(np.diff(shard))), np.append(at[1:], len(shard))):
                if low == high:
                    continue
                if held and held[0].column(held[0].schema.get_field_index("shard"))[0].as_py() != shard[low]:
                    yield from shuffled(held)
                held.append(b.slice(low, high - low))
        if held:
            yield from shuffled(held)

    return run


def write_shards(documents: DataFrame, path: str, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, parts: int = PARTS) -> DataFrame:
    """Writes the shuffled rows, whole shards to a file, and gives them as they are read back."""
    out = shuffle(documents, bucket_bytes, seed, parts)
    out.write.parquet(path)
    return documents.sparkSession.read.schema(out.schema).parquet(path)


def sharded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(table(spark, sf_dir, "documents"), f"{Scratch(spark).path}/shards")
