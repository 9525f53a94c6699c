"""An index of open documents on storage: batches of documents with their postings, tombstones, and a log of commits.

    <path>/docs/commit_id=K/part-*.parquet      _id, _source (JSON), _fields (values by kind)
    <path>/terms/commit_id=K/part-*.parquet     postings, packed, sorted by field, term and number
    <path>/deletes/commit_id=K/part-*.parquet   _id
    <path>/log/K.json                           first _id, number of documents, names of fields seen, whose work it is
    <path>/staged/<unique>/                     what no log entry names yet

A writer works in a folder of its own and then creates the log entry, which names that folder. Entries are created, never
overwritten: of two writers of one commit one fails, and has touched nothing that the other wrote. The winner moves its
folders to where readers and streams look; if it is lost before, the next to open the log moves them. So no reader or stream
ever meets rows that the log doesn't name. Readers take a snapshot: the commits up to one number. _ids are dense in order of
arrival. The file system must create files exclusively and rename folders at once, as HDFS does.

Queries on a snapshot start from the postings where these say that few documents can match, and scan otherwise.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable
from itertools import chain, islice
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import FieldConfig, IndexConfig
from ..functions.flatten import FIELDS, MADE, VALUES, open_fields
from ..operators.collection import Collection
from ..operators.fields import OpenFields
from ..operators.query import Query
from ..plans import postings as p

DOCS = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_source", T.StringType()), T.StructField(FIELDS, T.MapType(T.StringType(), VALUES)), T.StructField("commit_id", T.LongType())])
DELETES = T.StructType([T.StructField("_id", T.LongType()), T.StructField("commit_id", T.LongType())])
TERMS = T.StructType([*p.stored(T.LongType()).fields, T.StructField("commit_id", T.LongType())])
ENTRY = "commit_id long, start long, n long, names array<string>, staged string, config string, batch string"
PARTS = ("docs", "terms", "deletes")
CHUNK = 10_000  # documents of an iterable that the driver holds at once
RARE = 4  # postings lead where at most one in so many documents can match


class Index:
    def __init__(self, spark: SparkSession, path: str, config: IndexConfig | None = None):
        """Opens what is at the path, or begins there."""
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or IndexConfig()
        self.filters: dict[str, Query] = {}

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def commits(self) -> list[dict[str, Any]]:
        """The log in order; one small entry a commit."""
        fs, at = self._fs(f"{self.path}/log")
        if not fs.exists(at):
            return []
        rows = self.spark.read.schema(ENTRY).json(f"{self.path}/log").filter("commit_id is not null").collect()
        log = sorted((r.asDict() for r in rows), key=lambda r: r["commit_id"])
        fs, at = self._fs(f"{self.path}/staged")
        left = {x.getPath().getName() for x in fs.listStatus(at)} if fs.exists(at) else set()
        for entry in log:
            if entry["staged"] in left:
                self._publish(entry)
        return log

    def _enter(self, entry: dict[str, Any]) -> None:
        fs, at = self._fs(f"{self.path}/log/{entry['commit_id']:012d}.json")
        try:
            out = fs.create(at, False)
        except Py4JJavaError as e:
            raise RuntimeError(f"commit {entry['commit_id']} was written by someone else") from e
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
        out.close()

    def _publish(self, entry: dict[str, Any]) -> None:
        """Moves what the entry names to where readers look; what has been moved before stays."""
        for what in PARTS:
            fs, source = self._fs(f"{self.path}/staged/{entry['staged']}/{what}")
            if fs.exists(source):
                fs.mkdirs(self._fs(f"{self.path}/{what}")[1])
                target = self._fs(f"{self.path}/{what}/commit_id={entry['commit_id']}")[1]
                if not fs.rename(source, target) and not fs.exists(target):
                    raise RuntimeError(f"cannot move {source} to {target}")
        fs, own = self._fs(f"{self.path}/staged/{entry['staged']}")
        fs.delete(own, True)

    def _commit(self, log: list[dict[str, Any]], staged: str, **said: Any) -> None:
        """Claims the commit after the log that the writer saw; a loser's work is removed."""
        entry = {"commit_id": log[-1]["commit_id"] + 1 if log else 0, "start": _next(log), "n": 0, "names": [], "staged": staged, "config": fingerprint(self.config), **said}
        try:
            self._enter(entry)
        except RuntimeError:
            fs, own = self._fs(f"{self.path}/staged/{staged}")
            fs.delete(own, True)
            raise
        self._publish(entry)

    def add(self, documents: dict | Iterable[dict | str] | DataFrame, batch: int | None = None, label: str | None = None) -> int:
        """Adds one document, many, or a table (a `_source` column of JSON, else each row as an object); gives their number.

        All are one commit, but of an iterable with `batch`, each so many are. What is no JSON object is kept as it came and has
        no fields. With a `label` that an earlier commit has, nothing is added.
        """
        if batch is not None and batch < 1:
            raise ValueError("a batch must hold a document at least")
        if isinstance(documents, DataFrame):
            return self._add([self._sources(documents)], label)
        rest = iter([documents] if isinstance(documents, dict) else documents)
        if batch is None:
            return self._add((self._rows(c) for c in _chunks(rest, CHUNK)), label)
        return sum(self._add((self._rows(c) for c in _chunks(more, CHUNK)), None if label is None else f"{label}/{k}") for k, more in enumerate(_batches(rest, batch)))

    def _add(self, tables: Iterable[DataFrame], label: str | None = None) -> int:
        log = self.commits()
        if label is not None and any(c["batch"] == label for c in log):
            return 0
        staged, start = uuid.uuid4().hex, _next(log)
        own = f"{self.path}/staged/{staged}"
        # arrival order is that of tables, of partitions and of rows in them; staged, so that it can't change between the two passes
        for k, rows in enumerate(tables):
            rows.select("_source", F.lit(k).alias("_table"), F.monotonically_increasing_id().alias("_at")).write.mode("append").parquet(f"{own}/rows")
        fs, given = self._fs(f"{own}/rows")
        if not fs.exists(given):
            return 0
        rows = self.spark.read.schema("_source string, _table int, _at long").parquet(f"{own}/rows").withColumn("part", F.shiftright("_at", 33))
        sizes = rows.groupBy("_table", "part").agg((F.max("_at") - F.min("_at") + 1).alias("size"))
        before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("_table", "part")) - F.col("size")).drop("size")
        # a row of three numbers for each partition that wrote: small whatever the documents, and a join by it would be skewed
        dense = rows.join(F.broadcast(before), ["_table", "part"]).withColumn("_id", F.lit(start) + F.col("before") + F.col("_at") - F.shiftleft("part", 33))
        written = self._write(open_fields(self._generated(dense.select("_id", "_source"))).drop(MADE), own)
        n = written.count()
        names = [r[0] for r in written.select(F.explode(F.map_keys(FIELDS)).alias("name")).distinct().collect()]
        fs.delete(given, True)
        self._commit(log, staged, n=n, names=sorted(names), batch=label)
        return n

    def _write(self, docs: DataFrame, own: str) -> DataFrame:
        """Documents, and from these the postings; as they were written."""
        docs.write.parquet(f"{own}/docs")
        written = self.spark.read.schema(docs.schema).parquet(f"{own}/docs")
        p.write(p.open_values(written, self.config), f"{own}/terms")
        return written

    def follow(self, documents: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Adds a stream of documents, a commit for each of its batches; a batch that is run again after a failure is added once."""
        def batch(rows: DataFrame, number: int) -> None:
            self.add(rows, label=f"{checkpoint}/{number}")

        out = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if available_now else out).start()

    def _sources(self, documents: DataFrame) -> DataFrame:
        return documents.select("_source") if "_source" in documents.columns else documents.select(F.to_json(F.struct("*")).alias("_source"))

    def _rows(self, documents: list[dict | str]) -> DataFrame:
        return self.spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in documents], "_source string").coalesce(1)

    def _generated(self, rows: DataFrame) -> DataFrame:
        """Computed fields as a JSON object beside the source, which stays as it came; they override the source's own."""
        made = {n: c.generator for n, c in self.config.fields.items() if c.generator}
        return rows.withColumn(MADE, F.to_json(F.struct(*[g().alias(n) for n, g in made.items()]))) if made else rows

    def delete(self, keys: Iterable[int] | DataFrame) -> None:
        """Marks documents as gone from the next commit on."""
        log, staged = self.commits(), uuid.uuid4().hex
        rows = keys.select("_id") if isinstance(keys, DataFrame) else self.spark.createDataFrame([(k,) for k in keys], "_id long")
        rows.write.parquet(f"{self.path}/staged/{staged}/deletes")
        self._commit(log, staged)

    def _read(self, what: str, schema: T.StructType, upto: int) -> DataFrame:
        fs, at = self._fs(f"{self.path}/{what}")
        if not fs.exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}").filter(F.col("commit_id") <= upto)

    def snapshot(self, commit: int | None = None) -> Stored:
        """The documents of all commits up to one, without those deleted up to it."""
        log = self.commits()
        upto = (log[-1]["commit_id"] if log else -1) if commit is None else commit
        seen = [c for c in log if c["commit_id"] <= upto]
        gone = self._read("deletes", DELETES, upto).select("_id")
        docs = self._read("docs", DOCS, upto).drop("commit_id").join(gone, "_id", "left_anti")
        names = sorted(set().union(*[c["names"] for c in seen])) if seen else []
        mine = fingerprint(self.config)
        terms = p.unpacked(self._read("terms", TERMS, upto)) if seen and all(c["config"] == mine for c in seen) else None
        return Stored(docs, OpenFields(names, self.config), self.filters, terms, sum(c["n"] for c in seen))

    def compact(self, path: str, files: int | None = None) -> Index:
        """A new index at another path with one commit: the live documents under the same _ids, deleted ones left out."""
        now, made, staged = self.snapshot(), Index(self.spark, path, self.config), uuid.uuid4().hex
        made._write(now.df if files is None else now.df.repartitionByRange(files, "_id"), f"{made.path}/staged/{staged}")
        made._commit([], staged, n=_next(self.commits()), names=now.fields.names())
        return made

    def size(self) -> int:
        return self.snapshot().size()

    def names(self) -> list[str]:
        return self.snapshot().names()

    def query(self, query: Query, sort=None, limit=None, projection=None) -> DataFrame:
        return self.snapshot().query(query, sort, limit, projection)

    def aggregate(self, query: Query, parts: list) -> list[DataFrame]:
        return self.snapshot().aggregate(query, parts)


class Stored(Collection):
    """A snapshot: documents and, unless they were written under another configuration, their postings."""

    def __init__(self, df: DataFrame, fields: OpenFields, filters: dict[str, Query], terms: DataFrame | None, n: int):
        super().__init__(df, fields, True, filters)
        self.index, self.n = terms, n

    def filtered(self, query: Query) -> DataFrame:
        ids = None if self.index is None else p.leading(query, self.index, self.df, self.n // RARE)
        return super().filtered(query) if ids is None else self.df.join(ids, "_id", "left_semi")


def _next(log: list[dict[str, Any]]) -> int:
    return max((c["start"] + c["n"] for c in log), default=0)


def _chunks(rows: Iterable, size: int) -> Iterable[list]:
    rows = iter(rows)
    while chunk := list(islice(rows, size)):
        yield chunk


def _batches(rows: Iterable, size: int) -> Iterable[Iterable]:
    """The rest of the rows, as long as there is any; each taker takes up to `size`."""
    for first in rows:
        taken = chain([first], islice(rows, size - 1))
        yield taken
        for _ in taken:  # what the taker left
            pass


def fingerprint(config: IndexConfig) -> str:
    """What decides which postings a document has, and how they are written."""
    def of(c: FieldConfig) -> list:
        return [int(c.flags), c.in_all, None if c.analyzer is None else re.sub(r"_\d+|#\d+", "", c.analyzer(F.col("t"))._jc.toString())]

    every = {"layout": p.LAYOUT, "fields": {n: of(c) for n, c in sorted(config.fields.items())}, "default": of(config.default), "catch_all": of(config.catch_all)}
    return hashlib.sha256(json.dumps(every).encode()).hexdigest()
