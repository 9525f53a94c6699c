"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

Toxic documents go; of each group of near duplicates one document stays; documents that hold benchmark items go; each
source is cut to its budget; the rest is shuffled into shards. Every stage works on all that the one before it kept.
SQL can express neither the classifier nor the permutation, so there is no SQL for the whole (`ORACLE_SQL`); the tests
hold `run` against naive versions of the stages, one after the other.

Columns of documents pass through every stage as they came, whatever they are called. Rows with a null doc_id or text, and texts without words,
are never toxic, near duplicates or leaks; the mixing keeps them by the hash of their doc_id, and sharding keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontam, mixing, neardup, sharding, toxicity
from foliant.llm.shared import Scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier doesn't reject; it learns from the labels of the stage's own documents, and without labels of both kinds keeps all."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near duplicates, and all that resemble none; of rows of one doc_id and text, one."""
    return neardup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no item of the benchmark, word for word or as a paraphrase; an empty benchmark keeps all."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each source, a null one too, the documents of least hash that its budget holds: sources have equal weights and 0.6 of all tokens together."""
    return mixing.mix(docs)


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row and adds `shard` and `position`; to be written one file a shard."""
    return sharding.shuffle(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("sharding", shuffle_into_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the whole of documents; the stages between lie in the folder of spark.checkpoint.dir."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
