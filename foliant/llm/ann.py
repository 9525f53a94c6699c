"""Approximate nearest neighbours by collision counting.

Every vector is projected on LINES lines of a random rotation, and each line keeps its own sorted array, cut into CELLS
cells of equal numbers. A query looks at a window around its own place on every line; what lies in the windows of enough
lines is verified by its true distance. A window's half width follows from a radius, and virtual rehashing widens it: the
first radius comes from the query's closest on each line; while the k-th best distance found exceeds the radius, the
windows grow, and only what enters them is counted. A vector at the radius falls into a share of the windows that the
rotation settles; `enough` is that count's lower bound of chance MISS, taken from random directions on the very lines
used. When the windows stop, a vector at the k-th best distance has been verified with chance 1 - MISS or better, nearer
ones with more (on uniform vectors of 64 dimensions 0.99 of the k nearest are found).

A sorted array is kept as the sets of vectors before each cell's edge, 64 vectors a word, so a window is the difference
of two sets, what enters is the difference of two windows, and the collisions of all vectors are added up as columns of
bits: seven words of arithmetic for 64 vectors and a line. Windows end at cells' edges, never short of the radius.

Queries are the rows whose id is divisible by `every`, against all rows. Vectors are cut into data blocks and queries into
query blocks by hashes; each task has the sorted arrays of one data block and runs one query block through it, so a
vector travels as often as there are query blocks and a query as often as there are data blocks. The k best of each block are
merged in two steps. Nothing is broadcast and no candidates are capped. The work is queries x vectors with a small
constant, as it must be where neighbours are hardly nearer than strangers.

Defined results: a null or empty vector, one with a null or non-finite element, and a null id give no row and are nobody's
neighbour. Vectors of unlike lengths are spaces of their own. The row itself is not its own neighbour; rows of the same id
as the query aren't either. Ties go to the lesser id. Equal vectors are at distance 0. Fewer than k others give shorter lists.
Repeated rows of an id count once for each length, by the least vector. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import table

K = 10
EVERY = 50
LINES = 64
CELLS = 128
SPAN = 1.5
MISS = 0.2
CLOSE = 2  # neighbours on either side of each line that are verified first
DATA_BLOCK, QUERY_BLOCK = 32_768, 16_384
LEAST_BLOCK = 4_096  # vectors below which a block isn't cut further to keep cores busy
BATCH = 64
SEED = 3


def lines(size: int) -> np.ndarray:
    """LINES directions of one or more random rotations, scaled so that a unit vector's heights have variance 1."""
    r = np.random.default_rng(SEED)
    turns = [np.linalg.qr(r.normal(size=(size, min(size, LINES))))[0] for _ in range(-(-LINES // size))]
    return (np.concatenate(turns, 1)[:, :LINES] * math.sqrt(size)).astype(np.float32)


def enough(a: np.ndarray, miss: float = MISS) -> int:
    """The most collisions that a vector within the radius has with chance 1 - miss."""
    u = np.random.default_rng(SEED + 1).normal(size=(20_000, a.shape[0])).astype(np.float32)
    hits = (np.abs(u @ a) < SPAN * np.linalg.norm(u, axis=1)[:, None]).sum(1)
    return max(1, int(np.quantile(hits, miss, method="lower")))


class Tally:
    """Collisions of many vectors with many queries, added up as columns of bits."""

    def __init__(self, shape: tuple[int, int]):
        self.planes = [np.zeros(shape, np.uint64) for _ in range(LINES.bit_length())]
        self.waiting: list[np.ndarray | None] = [None] * (LINES.bit_length() + 1)

    def add(self, x: np.ndarray, level: int = 0) -> None:
        """One more for the vectors of the set x, or 2**level more."""
        while level < len(self.planes):
            y = self.waiting[level]
            if y is None:
                self.waiting[level] = x
                return
            self.waiting[level] = None
            p = self.planes[level]
            u = p ^ x
            carry = p & x
            np.bitwise_xor(u, y, out=p)
            u &= y
            carry |= u
            x, level = carry, level + 1

    def settle(self) -> None:
        for level, p in enumerate(self.planes):
            y, self.waiting[level] = self.waiting[level], None
            while y is not None and level < len(self.planes):
                carry = self.planes[level] & y
                self.planes[level] ^= y
                level += 1
                y = carry if level < len(self.planes) and carry.any() else None

    def only(self, rows: np.ndarray) -> None:
        self.planes = [p[rows] for p in self.planes]

    def at_least(self, n: int) -> np.ndarray:
        over, even = np.zeros_like(self.planes[0]), ~np.zeros_like(self.planes[0])
        for level in range(len(self.planes) - 1, -1, -1):
            p = self.planes[level]
            if n >> level & 1:
                even &= p
            else:
                over |= even & p
                even &= ~p
        return over | even


class SortedArrays:
    """The sorted arrays of one data block, and searches in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n = len(ids)
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        self.a = lines(vectors.shape[1])
        self.least = enough(self.a)
        heights = np.ascontiguousarray((vectors @ self.a).T)
        self.order = np.argsort(heights, axis=1, kind="stable")
        self.sorted = np.take_along_axis(heights, self.order, 1)
        self.words = -(-n // 64)
        self.starts = np.arange(CELLS + 1) * n // CELLS  # places at which cells begin
        self.before = np.empty((LINES, CELLS + 1, self.words), np.uint64)
        place, bits = np.empty(n, np.int32), np.zeros((CELLS + 1, self.words * 64), bool)
        for k, order in enumerate(self.order):
            place[order] = np.arange(n, dtype=np.int32)
            np.less(place[None, :], self.starts[:, None], out=bits[:, :n])
            self.before[k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def distances(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norms[rows] + q @ q - 2 * (self.vectors[rows] @ q), 0))

    def windows(self, h: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last edge of each line's window of each query."""
        low = np.stack([np.searchsorted(s, x - half, "left") for s, x in zip(self.sorted, h)])
        high = np.stack([np.searchsorted(s, x + half, "right") for s, x in zip(self.sorted, h)])
        return np.searchsorted(self.starts, low, "right") - 1, np.searchsorted(self.starts, high, "left")

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, rows and distances of the k nearest of other ids, nearest first."""
        n, m = len(self.ids), len(queries)
        h = np.ascontiguousarray((queries @ self.a).T)
        at = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, h)])
        near = np.clip(at[:, :, None] + np.arange(-CLOSE, CLOSE), 0, n - 1)
        near = np.stack([o[x] for o, x in zip(self.order, near)], 1).reshape(m, -1)
        rows: list[np.ndarray] = []
        dist: list[np.ndarray] = []
        radius = np.empty(m)

        def kth(i: int) -> float:
            return float(np.partition(dist[i], k - 1)[k - 1]) if len(dist[i]) >= k else np.inf

        seen = np.zeros((m, self.words * 64), bool)
        for i, q in enumerate(queries):
            r = np.unique(near[i])
            seen[i, r] = True
            r = r[self.ids[r] != q_ids[i]]
            rows.append(r)
            dist.append(self.distances(q, r))
            radius[i] = 0.9 * kth(i)
        known = np.packbits(seen, axis=1, bitorder="little").view(np.uint64)
        going, tally = np.arange(m), Tally((m, self.words))
        low = high = None
        while len(going):
            l, r = self.windows(h[:, going], SPAN * radius[going])
            if low is not None:
                l, r = np.minimum(l, low), np.maximum(r, high)
            for line in range(LINES):
                b = self.before[line]
                x = b[r[line]]
                x ^= b[l[line]]
                if low is not None:  # only what enters
                    x ^= b[high[line]]
                    x ^= b[low[line]]
                tally.add(x)
            tally.settle()
            fresh = tally.at_least(self.least) & ~known[going]
            known[going] |= fresh
            found = np.unpackbits(fresh.view(np.uint8), axis=1, count=n, bitorder="little")
            more = []
            for g, i in enumerate(going):
                r_ = np.flatnonzero(found[g])
                r_ = r_[self.ids[r_] != q_ids[i]]
                rows[i] = np.concatenate([rows[i], r_])
                dist[i] = np.concatenate([dist[i], self.distances(queries[i], r_)])
                best = kth(i)
                whole = not l[:, g].any() and (r[:, g] == CELLS).all()
                if best > radius[i] and not whole:
                    more.append(g)
                    # beyond the k-th best found nothing can be of use; never shrinks, and grows at least a little
                    radius[i] = max(np.nextafter(radius[i], np.inf), best) if best < 1.5 * radius[i] or radius[i] == 0 else 1.5 * radius[i]
            low, high = l[:, more], r[:, more]
            tally.only(np.array(more, int))
            going = going[more]
        out = []
        for i, q in enumerate(queries):
            r = rows[i][dist[i] <= kth(i) + 1e-2 * (1 + np.sqrt(q @ q))]  # exact distances for all that rounding might let in
            d = np.sqrt(((self.vectors[r].astype(np.float64) - q) ** 2).sum(1))
            best = np.lexsort((self.ids[r], d))[:k]
            out.append((r[best], d[best]))
        return out


def neighbours(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = K, every: int = 1, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """key, neighbours (ids, nearest first), distances for every usable row of vectors whose key is divisible by `every`."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(column).cast("array<float>")
    whole = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    whole = whole.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    asked = F.pmod("id", F.lit(every)) == 0
    sizes = whole.agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("asked")).first()
    one = whole.groupBy("id", F.size("v").alias("dim")).agg(F.min("v").alias("v"))
    n, busy = sizes["n"], min(spark.sparkContext.defaultParallelism, math.ceil(sizes["n"] / LEAST_BLOCK))
    data, query = max(1, busy, math.ceil(n / data_block)), max(1, math.ceil(sizes["asked"] / query_block))
    mine = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(data)).cast("int")
    asks = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(query)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = one.select("id", "v", "dim", mine.alias("d"), each(query).alias("q"))
    right = one.filter(asked).select(*[F.col(c).alias(c) for c in ("id", "v", "dim")], each(data).alias("d"), asks.alias("q"))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return t.column("id").to_numpy(), np.ascontiguousarray(flat.reshape(t.num_rows, -1))

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], pa.int64()), "dim": pa.array([], pa.int32()), "d": pa.array([], pa.int32()), "best": pa.array([], pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())])))})
        if not queries.num_rows:
            return empty
        ids, q = matrix(queries)
        dim, d = queries.column("dim")[0].as_py(), queries.column("d")[0].as_py()
        if block.num_rows:
            arrays = SortedArrays(*matrix(block))
            found = [x for i in range(0, len(ids), BATCH) for x in arrays.search(ids[i : i + BATCH], q[i : i + BATCH], k)]
        else:
            arrays, found = None, []
        ends = np.append(0, np.cumsum([len(r) for r, _ in found] if found else np.zeros(len(ids), int)))
        of = lambda pick, t: np.concatenate([pick(x) for x in found]) if found else np.zeros(0, t)
        best = pa.StructArray.from_arrays([pa.array(of(lambda x: x[1], float), pa.float64()), pa.array(of(lambda x: arrays.ids[x[0]], np.int64), pa.int64())], names=["d", "id"])
        return pa.table({"id": pa.array(ids), "dim": pa.array(np.full(len(ids), dim, np.int32)), "d": pa.array(np.full(len(ids), d, np.int32)), "best": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), best)})

    kinds = "id long, dim int, d int, best array<struct<d:double,id:long>>"
    parts = left.groupBy("dim", "d", "q").cogroup(right.groupBy("dim", "d", "q")).applyInArrow(run, kinds)
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    teams = max(1, math.isqrt(data))
    merged = parts.groupBy("id", "dim", F.pmod("d", F.lit(teams)).alias("team")).agg(best).groupBy("id", "dim").agg(best)
    return merged.select(F.col("id").alias(key), F.col("best.id").alias("neighbours"), F.col("best.d").alias("distances"))


def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), every=EVERY)
