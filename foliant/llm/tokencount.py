"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut into words by the vocabulary's pattern. Each word starts as a list of bytes; a heap gives the adjacent pair of
lowest rank, leftmost among equals, again and again until no pair has a rank. The count is the initial symbols minus the
merges; no identifiers are made. Costs O(n log n) for a word of n bytes, however long, and a worker keeps the counts of
words it has seen.

Defined results: a null text has null counts, an empty one 0; repeated rows are each counted; text that looks like a special token
is ordinary text. Other columns are not read. The vocabulary is a file of "base64 rank" lines whose path is a parameter;
the driver reads it and sends its ranks, under a megabyte, to the workers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Words, in_arrow, spread, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def merges(word: bytes, ranks: dict[bytes, int]) -> int:
    """How many pairs merge in a word."""
    n = len(word)
    if n < 2:
        return 0
    get = ranks.get
    after = list(range(1, n + 1))  # where the symbol that starts here ends, hence where the next one starts
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapify(heap)
    alive = bytearray(b"\1") * n
    done = 0
    while heap:
        _, i, j, end = heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or after[j] != end:
            continue
        done += 1
        alive[j] = 0
        after[i] = end
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]])) is not None:
                heappush(heap, (r, i, end, after[end]))
        h = before[i]
        if h >= 0 and (r := get(word[h:end])) is not None:
            heappush(heap, (r, h, i, end))
    return done


def symbols_left(word: str, ranks: dict[bytes, int]) -> int:
    b = word.encode("utf-8", "replace")
    return len(b) - merges(b, ranks)


def token_counts(texts: DataFrame, key: str, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """key, bytes (initial symbols), tokens for every row of texts."""
    ranks = read_ranks(path)
    shared = texts.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, cut = shared.value, regex.compile(pattern)
        words = Words(lambda w: symbols_left(w, ranks), limit=500_000)
        count = words.__getitem__

        def tokens(text: str | None) -> int | None:
            if text is None:
                return None
            if len(text) < LONG:
                return sum(map(count, cut.findall(text)))
            return sum(count(m.group()) for m in cut.finditer(text))

        for b in batches:
            column = b.column(1)
            size = pa.compute.binary_length(column).cast(pa.int64())
            out = pa.array((tokens(x.as_py()) for x in column), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, out], names=[key, "bytes", "tokens"])

    rows = texts.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    return in_arrow(spread(rows), run, f"`{key}` long, bytes long, tokens long")


def counted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "doc_id")
