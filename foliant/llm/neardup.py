"""MinHash near-duplicates by an LSH forest.

Every document's set of three-word shingles gets TREES x DEPTH minimum hashes. Each tree orders all documents by its own
DEPTH values, so that those with the longest common prefixes lie side by side. Documents that share the first LEAST values
of an order form a region, and all pairs of a region are compared by their whole signatures. One of over SMALL documents
is compared in blocks of about SMALL by SMALL, so that no task holds it. Depth follows the density: where a region holds over
SMALL x MANY documents, they are split by the next value, and so on down to the full depth.

What no order brings together is found by twos: the values of a signature are taken in threes, and texts that have two values of
a three in common are compared too, whatever the orders missed, by chance or because a region was split. So a pair that shares over a third
of the values always is compared, and one of similarity s is missed with probability ((1-s)**2 * (1+2*s))**32 at most: 2e-10 at 0.5.

Pairs whose estimate is at most LOOSE under the threshold are candidates; from SURE above it on they are accepted (estimates
that are five standard deviations off), and the exact Jaccard similarity of the shingle sets decides on all others, so chance
estimates join nobody. Documents of the same shingles are joined beforehand and enter the orders as one, so thousands of copies
cost what one costs. Groups are the connected components of the joined pairs; all links between different texts are
counted. What can still differ from comparing all sets are equal hashes of unlike shingles or regions (32 bits each), and estimates five
standard deviations off (5e-7 of pairs at the threshold).

A pair that shares a region is never written. It belongs to the first order in which it does, so each is looked at once; a
region gives out how many links each of its texts has, edges that span what is joined, and which texts need their sets. Those
are sent once to each such region, which decides there and gives out the like. So what moves is linear in documents,
though links in a cluster grow as its square; only regions over SMALL are sent once for each of their blocks. Pairs that share
no region are written, if they are candidates.

A pair of similarity s is seen in one order of depth d with probability
s**d, hence in some order with 1-(1-s**d)**TREES: at depth 2 with 0.968 at 0.5, 0.997 at 0.6, above 0.9999 at 0.75. The twos
find the rest.

Defined results: null or wordless texts, and rows with a null doc_id, belong to no group. Texts of one or two words are one shingle. Case and ASCII
punctuation don't count. Repeated rows of one doc_id are one document: `near_duplicates` doesn't list them for
that alone; `drop_near_duplicates` keeps one of its rows of equal text, that of least hash of the whole row. Ties go to
the least doc_id. Other columns are never read by the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, chunks, hashed_words, in_arrow, spread, table

TREES, DEPTH, LEAST = 12, 8, 2
HASHES = TREES * DEPTH
SHINGLE = 3
THRESHOLD = 0.5
SMALL, MANY = 1024, 32
LOOSE, SURE = 0.25, 0.25
TEXTS = 1 << 14  # whose twos are sorted at once
TWOS = [(k + i, k + j) for k in range(0, HASHES, 3) for i, j in ((0, 1), (0, 2), (1, 2))]
FEW = 1_000_000  # ids, of eight bytes, up to which they are broadcast

_r = np.random.default_rng(20240229)
_A = _r.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _r.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_C = [np.uint64(int(x) | 1) for x in _r.integers(1 << 62, 1 << 63, 3)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def shingles(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32 bits of each shingle of documents with at least one word each, and where each document's start."""
    n = np.diff(starts)
    if (n < SHINGLE).any():
        full = np.maximum(n, SHINGLE)
        place = np.repeat(np.cumsum(full) - full, n) + np.arange(len(words)) - np.repeat(starts[:-1], n)
        padded = np.zeros(full.sum(), np.uint32)
        padded[place] = words
        words, starts = padded, np.append(0, np.cumsum(full))
    w = words.astype(np.uint64)
    h = w[:-2] * _C[0] + w[1:-1] * _C[1] + w[2:] * _C[2]
    inside = np.ones(len(h), bool)
    ends = starts[1:-1]
    inside[ends - 1] = inside[ends - 2] = False
    x = mixed((h[inside] >> np.uint64(32)).astype(np.uint32))
    return x, starts[:-1] - (SHINGLE - 1) * np.arange(len(starts) - 1)


def whole(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits of each document's shingles, whatever their order."""
    y = (x.astype(np.uint64) + np.uint64(1)) * _C[0]
    y ^= y >> np.uint64(29)
    y *= _C[1]
    y ^= y >> np.uint64(32)
    return (np.add.reduceat(y * _C[2], starts)).view(np.int64)


def signatures(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return minima(*shingles(words, starts))


def minima(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES minima of each document, as 32-bit values."""
    out = np.empty((len(starts), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(x * _A[k] + _B[k], starts)
    return mixed(out)


def worded(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")


def signature_table(documents: DataFrame) -> DataFrame:
    """doc_id, node (64 bits of all shingles), keys (16 bits a value, in the order of the trees), sig (8 bits a value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                words, starts = hashed_words(b.column(1).to_pylist())
                some = np.flatnonzero(np.diff(starts))
                if not len(some):
                    continue
                x, first = shingles(words, np.append(starts[some], starts[-1]))
                s, node = minima(x, first), whole(x, first)
                keys, sig = (s >> np.uint32(16)).astype(">u2"), s.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(node), pa.array([x.tobytes() for x in keys], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "node", "keys", "sig"])

    return in_arrow(spread(worded(documents)), run, "doc_id long, node long, keys binary, sig binary")


def likeness(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimated similarity; equal bytes of unequal values are allowed for."""
    return ((sig == other).mean(-1) - 1 / 256) / (1 - 1 / 256)


def placed(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(tree, region, node, size) of every text in every order where it isn't alone, and (node, sig, regions), from (node, keys, sig); regions has 32 bits of that of each order.

    Regions that go deeper are few (one in SMALL x MANY rows at most), so their table is small beside the orders;
    Spark joins it by its size, and splits the orders' side where a region is hot.
    """
    prefix = lambda d: F.substring("key", 1, 2 * d)
    region = lambda *more: F.xxhash64("tree", *more)
    upper = lambda r: F.shiftright(r, 32).cast("int")
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("keys", 1 + t * 2 * DEPTH, 2 * DEPTH).alias("key")) for t in range(TREES)])
    rows = texts.select("node", F.explode(trees).alias("x")).select("x.tree", "x.key", "node", F.lit(LEAST).alias("depth"))
    sized = lambda rows, name: scratch.save(rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), name)
    for d in range(LEAST, DEPTH):
        sizes = sized(rows.filter(F.col("depth") == d).select(region(prefix(d)).alias("region")), f"sizes-{d}")
        dense = sizes.filter(F.col("size") > SMALL * MANY).select(F.col("region").alias("dense"))
        if not dense.limit(1).count():
            break
        rows = rows.join(dense, (F.col("depth") == d) & (region(prefix(d)) == F.col("dense")), "left").withColumn("depth", F.when(F.col("dense").isNotNull(), d + 1).otherwise(F.col("depth"))).drop("dense")
    else:
        d = DEPTH
    if d == LEAST:
        heads = texts.withColumn("heads", F.transform(trees, lambda x: F.xxhash64(x["tree"], F.substring(x["key"], 1, 2 * LEAST))))
        found, own = heads.select("node", F.posexplode("heads").alias("tree", "region")), heads.select("node", "sig", F.transform("heads", upper).alias("regions"))
    else:
        found = scratch.save(rows.select("tree", "node", region(F.expr("substring(key, 1, 2 * depth)")).alias("region")), "regions")
        mine = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("tree", upper("region").alias("region")))).alias("r"))  # TREES of them
        own = scratch.save(mine.join(texts.select("node", "sig"), "node").select("node", "sig", F.col("r.region").alias("regions")), "own")
        sizes = sized(found, "sizes")
    return found.join(sizes, "region").select("tree", "region", "node", "size"), own


def in_blocks(rows: DataFrame) -> DataFrame:
    """(tree, region, side, node), where regions of over SMALL are cut into random parts and each two parts are a region; side is 0 or 1 then, and only pairs of both sides count, else 2."""
    parts = F.ceil(F.col("size") / SMALL)
    each = rows.withColumn("own", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    region = F.when(F.col("size") <= SMALL, F.col("region")).otherwise(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    return each.select("tree", region.alias("region"), side.alias("side"), "node")


def twos(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, twos, nodes: TWOS of each text with their values, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                b = batch.slice(at, TEXTS)
                keys = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u2").reshape(-1, HASHES).astype(np.uint64)
                two = np.stack([keys[:, i] << np.uint64(16) | keys[:, j] | np.uint64(n << 32) for n, (i, j) in enumerate(TWOS)], 1).ravel()
                node = np.repeat(b.column(0).to_numpy(), len(TWOS))
                bucket = ((two * _C[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                two, node, bucket = two[order], node[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                rows = lambda a: pa.array([x.tobytes() for x in np.split(a, cuts)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[np.append(0, cuts)]), rows(two), rows(node)], names=["bucket", "twos", "nodes"])

    return in_arrow(texts.select("node", "keys"), run, "bucket int, twos binary, nodes binary")


def sharing(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, region, node, size) of texts that share one of TWOS. Texts that share it are a region; those with the same least and greatest node
    give one together, so a cluster is not sent for each of its twos."""
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(t: pa.Table) -> pa.Table:
        two, nodes = np.frombuffer(b"".join(t.column("twos").to_pylist()), np.uint64), np.frombuffer(b"".join(t.column("nodes").to_pylist()), np.int64)
        order = np.argsort(two, kind="stable")
        near = two[order]
        near = np.flatnonzero(near[1:] == near[:-1])
        order = order[np.unique(np.append(near, near + 1))]  # others are of one text
        order = order[np.lexsort((nodes[order], two[order]))]
        two, nodes = two[order], nodes[order]
        starts = np.flatnonzero(np.append(True, two[1:] != two[:-1])) if len(two) else np.zeros(0, np.int64)
        if not len(starts):
            return pa.table({"region": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
        ends = np.append(starts[1:], len(two))
        least, most = nodes[starts].view(np.uint64), nodes[ends - 1].view(np.uint64)
        y = least * _C[0]
        y ^= y >> np.uint64(32)
        y = (y + most) * _C[1]
        y ^= y >> np.uint64(29)
        name, node = np.repeat((y * _C[2]).view(np.int64), ends - starts), nodes
        order = np.lexsort((node, name))
        name, node = name[order], node[order]
        new = np.ones(len(node), bool)
        new[1:] = (name[1:] != name[:-1]) | (node[1:] != node[:-1])
        return pa.table({"region": name[new], "node": node[new]})

    found = twos(texts, buckets).groupBy("bucket").applyInArrow(run, "region long, node long").distinct()
    found = scratch.save(found, "sharing")
    sizes = found.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, "region").select(F.lit(TREES).alias("tree"), "region", "node", "size")


RESULTS = "kind int, region long, a long, b long, tree int, side int, sig binary, regions array<int>"
EDGE, LINKS, NEEDS, PAIR = 0, 1, 2, 3  # a and b are joined; a has b links more; a's set is needed in the region, and here is its row; a and b share no region of the orders


def by_region(rows: DataFrame, decide) -> DataFrame:
    """RESULTS of each region, from rows (region, tree, side, node, sig, regions and, at times, set); `decide` gets a region's."""
    lined = rows.repartition("region").sortWithinPartitions("region", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def all_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            """Results of some whole regions."""
            t = pa.Table.from_batches(parts).combine_chunks()
            names, tree, side, nodes = (t.column(k).to_numpy() for k in ("region", "tree", "side", "node"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            regions = t.column("regions").combine_chunks().flatten().to_numpy().reshape(-1, TREES)
            sets = t.column("set") if "set" in t.column_names else None
            starts = np.append(0, 1 + np.flatnonzero(names[1:] != names[:-1]))
            out = []
            for low, high in zip(starts, np.append(starts[1:], len(nodes))):
                if high - low > 1:
                    for kind, a, b in decide(nodes[low:high], sig[low:high], regions[low:high, : tree[low]], side[low:high], None if sets is None else sets.slice(low, high - low)):
                        out.append((np.full(len(a), kind), np.full(len(a), names[low]), a, b + low if kind == NEEDS else b))
            kind, region, a, b = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
            at = pa.array(b, mask=kind != NEEDS)  # of those, b is the row's number
            more = [t.column(c).combine_chunks().take(at) for c in ("tree", "side", "sig", "regions")]
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(region), pa.array(a), pa.array(b), *more], names=["kind", "region", "a", "b", "tree", "side", "sig", "regions"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(batch.schema.get_field_index("region")).to_numpy()
            if held and names[-1] == held[0].column(held[0].schema.get_field_index("region"))[0].as_py():
                held.append(batch)
                continue
            edges = np.flatnonzero(names[1:] != names[:-1])
            last = int(edges[-1]) + 1 if len(edges) else 0
            if held or last:
                yield all_of([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        if held:
            yield all_of(held)

    return in_arrow(lined, run, RESULTS)


class Joined:
    """What is joined in a region, and how often each text is linked."""

    def __init__(self, n: int):
        self.root, self.links, self.edges = list(range(n)), np.zeros(n, np.int64), []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        self.links[i] += len(others)
        self.links[others] += 1
        for j in others.tolist():
            x, y = self.find(i), self.find(j)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.edges.append((i, j))

    def results(self, nodes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        some = np.flatnonzero(self.links)
        yield LINKS, nodes[some], self.links[some]
        if self.edges:
            e = np.array(self.edges)
            yield EDGE, nodes[e[:, 0]], nodes[e[:, 1]]


def alike(sig: np.ndarray, before: np.ndarray, side: np.ndarray, low: float, high: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """i, the rows after it whose estimate is from low to below high and that share no region of `before` with it, and their estimates."""
    right = int(np.searchsorted(side, 1))  # rows are ordered by side
    for i in range(len(sig) - 1 if side[0] == 2 else right):
        j = max(i + 1, right) if side[0] != 2 else i + 1
        like = likeness(sig[j:], sig[i])
        hit = np.flatnonzero((like >= low) & (like < high))
        hit = hit[~(before[j + hit] == before[i]).any(1)]
        if len(hit):
            yield i, j + hit, like[hit]


def estimated(threshold: float):
    """Decides on a region by the signatures alone; names the texts whose sets are needed for the rest."""
    least, sure = threshold - LOOSE, min(threshold + SURE, 0.95)

    def decide(nodes: np.ndarray, sig: np.ndarray, before: np.ndarray, side: np.ndarray, sets) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if before.shape[1] == TREES:  # these may meet again, so pairs are named
            for i, hit, _ in alike(sig, before, side, least, np.inf):
                yield PAIR, np.minimum(nodes[i], nodes[hit]), np.maximum(nodes[i], nodes[hit])
            return
        joined, needs = Joined(len(nodes)), np.zeros(len(nodes), bool)
        for i, hit, like in alike(sig, before, side, least, np.inf):
            over = like >= sure
            joined.join(i, hit[over])
            if not over.all():
                needs[i] = needs[hit[~over]] = True
        yield from joined.results(nodes)
        yield NEEDS, nodes[needs], np.flatnonzero(needs)

    return decide


def exact(threshold: float):
    """Decides on the pairs of a region that the signatures leave in doubt by their sets."""
    least, sure = threshold - LOOSE, min(threshold + SURE, 0.95)

    def decide(nodes: np.ndarray, sig: np.ndarray, before: np.ndarray, side: np.ndarray, sets) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        joined = Joined(len(nodes))
        own = [np.frombuffer(x.as_buffer(), np.uint32) for x in sets]
        size = np.array([len(x) for x in own])
        for i, hit, _ in alike(sig, before, side, least, sure):
            for part in np.split(hit, np.flatnonzero(np.diff(np.cumsum(size[hit]) >> 20)) + 1):  # about a million shingles at once
                x = np.concatenate([own[j] for j in part])
                at = np.minimum(np.searchsorted(own[i], x), size[i] - 1)
                both = np.add.reduceat((own[i][at] == x).astype(np.int64), np.cumsum(size[part]) - size[part])
                joined.join(i, part[both >= threshold * (size[part] + size[i] - both)])
        yield from joined.results(nodes)

    return decide


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of texts whose sets meet the threshold."""
    of = lambda n: sets.select(F.col("node").alias(n), F.col("set").alias(f"set_{n}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                kept[k] = both >= threshold * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    return in_arrow(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b"), run, "a long, b long")


def shingle_table(documents: DataFrame) -> DataFrame:
    """node, set: the sorted distinct shingles of a text, four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                words, starts = hashed_words(b.column(1).to_pylist())
                some = np.flatnonzero(np.diff(starts))
                if not len(some):
                    continue
                x, first = shingles(words, np.append(starts[some], starts[-1]))
                sets = [np.unique(part).tobytes() for part in np.split(x, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(whole(x, first)), pa.array(sets, pa.binary())], names=["node", "set"])

    return in_arrow(documents, run, "node long, set binary")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the least node of each connected component of pairs (a, b)."""
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")), "both")
    label = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "label")
    while True:
        near = both.join(label, both.b == label.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        before = label
        step = scratch.save(label.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label")), "step")
        up = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        label = scratch.save(step.join(up, "label").select("node", "was", F.col("further").alias("label")), "label")
        scratch.remove(before, step)
        if not label.filter("label < was").limit(1).count():
            scratch.remove(both)
            return label.select("node", "label")


def groups(documents: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, Scratch]:
    """(doc_id, group_id) of every document that resembles another, (doc_id, links), and where these tables lie."""
    scratch = Scratch(documents.sparkSession)
    sigs = scratch.save(signature_table(documents), "signatures")
    members = scratch.save(sigs.select("node", "doc_id").distinct(), "members")
    # the keys and signatures of equal shingles are equal
    texts = scratch.save(sigs.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "texts")
    least = texts.select("node", "rep")
    orders, own = placed(texts, scratch)
    shared = sharing(texts, scratch)
    first = scratch.save(by_region(in_blocks(orders.union(shared)).join(own, "node"), estimated(threshold)), "estimated")
    needs = first.filter(F.col("kind") == NEEDS).select("region", F.col("a").alias("node"), "tree", "side", "sig", "regions")
    pairs = scratch.save(first.filter(F.col("kind") == PAIR).select("a", "b").distinct(), "pairs")
    wanted = needs.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    ids = scratch.save(least.join(wanted, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    few = ids.count() <= FEW
    some = worded(documents).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = scratch.save(shingle_table(spread(some)).dropDuplicates(["node"]), "sets")
    second = scratch.save(by_region(needs.join(sets, "node"), exact(threshold)), "exact")
    apart = scratch.save(verified(pairs, sets, threshold), "apart")
    every = first.union(second).select("kind", "a", "b")
    edges = every.filter(F.col("kind") == EDGE).select("a", "b").union(apart)
    rep = lambda n: least.select(F.col("node").alias(n), F.col("rep").alias(f"rep_{n}"))
    between = edges.select("a", "b").join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    equal = members.join(least, "node").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = components(between.union(equal).filter("a <> b").distinct(), scratch).select(F.col("node").alias("doc_id"), F.col("label").alias("group_id"))
    one = lambda n: apart.select(F.col(n).alias("a"), F.lit(1).cast("bigint").alias("b"))
    counted = every.filter(F.col("kind") == LINKS).select("a", "b").union(one("a")).union(one("b")).groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    links = scratch.save(members.join(counted, "node").groupBy("doc_id").agg(F.sum("links").alias("links")), "links")
    scratch.remove(sigs, members, texts, first, pairs, ids, sets, second, apart)
    return found, links, scratch


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, group_id, keep, links: every document that resembles another, with the number of different texts that
    resemble it; the least doc_id of its group is kept."""
    found, links, _ = groups(documents, threshold)
    return found.join(links, "doc_id", "left").select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("keep"), F.coalesce("links", F.lit(0)).alias("links"))


def drop_near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents without those that a document of lesser doc_id stands for, all columns as they came.

    One join on doc_id, by sorting, as what goes grows with the corpus. Only if a doc_id repeats is there a second pass for its rows.
    """
    found, _, scratch = groups(documents, threshold)
    full = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    repeated = scratch.save(documents.filter(full).groupBy(F.col("doc_id").alias("__again")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__again"), "repeated")
    dropped = found.filter("doc_id <> group_id").select(F.col("doc_id").alias("__gone"))
    rest = documents.join(dropped.hint("merge"), documents.doc_id == F.col("__gone"), "left_anti")
    if not repeated.limit(1).count():
        return rest
    once = rest.join(repeated, (rest.doc_id == F.col("__again")) & full, "left_anti")
    again = rest.filter(full).join(repeated, rest.doc_id == F.col("__again"), "left_semi")
    whole = F.xxhash64(*[F.col(f"`{f.name}`") if not isinstance(f.dataType, (T.MapType, T.VariantType)) else F.to_json(F.col(f"`{f.name}`")) for f in documents.schema])
    first = Window.partitionBy("doc_id", "text").orderBy("__whole")
    return once.union(again.withColumn("__whole", whole).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__whole", "__n"))


def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
