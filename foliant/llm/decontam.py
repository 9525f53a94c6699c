"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to 2**BITS terms. One pass writes each document as its terms, one counts document frequencies, one gives
the randomised range of the TF-IDF matrix of all passages of all documents (the Gram matrix times a Gaussian block, summed
by Spark), of which the driver takes the leading singular vectors (Nystrom form, so no further pass). The last pass maps
windows of every document, one from every other block on, to latent vectors and compares them with each piece of each
benchmark item, the windows being a block longer than the piece. Windows of cosine COSINE or more are checked by the longest common subsequence with the
item: a share of VERBATIM of the item's words in order is a leak; from PARAPHRASE on it is one if most of the item's
answer (its last ANSWER words that aren't stop terms) also stands there.

Cosines follow the rare words, so an item whose rare words were replaced would be missed. Therefore every stretch of
twice an item's words that holds a share PARAPHRASE of its places is checked too, whatever its cosine. No common subsequence
can be longer than that, so nothing that the check would find is lost.

Items of fewer than SHORT words leave too little for shares of words: a document holds one if all its words follow each
other there, by 32 bits of each word.

What the driver holds is 2**BITS x RANK numbers, whatever the corpus, and one slice of the benchmark at a time; slices are
of at most SLICE items and SLICE_WORDS words (or one item), so the broadcast is bounded too. Every step is linear in the
documents.

Defined results: null or wordless texts, null doc_ids and null item_ids match nothing. An item of several pieces is compared piece by piece and checked as a whole. Repeated documents and items
give one row for each pair of ids. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, chunks, hashed_words, in_arrow, ragged, spread, table

BITS = 15
TERMS = 1 << BITS
RANK, EXTRA = 96, 16
BLOCK = 8
PASSAGE = 64  # words of a passage of the matrix, and of the longest piece of an item
COSINE = 0.4
VERBATIM, PARAPHRASE = 0.7, 0.55
ANSWER, ANSWER_SHARE = 8, 0.75
SHORT = 5
COMMON = 0.005
TELLING = 5
SLICE, SLICE_WORDS = 1024, 1 << 18
LANES = 256  # pieces whose places are looked up at once
STRETCH = 512  # blocks looked at at once
PAIRS = 8192  # stretches and items checked at once
SEED = 11
LEAKS = "doc_id long, item_id long, cosine double, common long, words long"
TEAM = 512  # tasks whose blocks of the matrix product are added up first


def terms_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The term of every word, and where each text's start."""
    h, starts = hashed_words(texts)
    return folded(h), starts


def folded(words: np.ndarray) -> np.ndarray:
    return (1 + words % np.uint32(TERMS - 1)).astype(np.uint16)


def worded(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")


def term_table(documents: DataFrame) -> DataFrame:
    """doc_id and all terms of the text, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                ids, starts = terms_of(b.column(1).to_pylist())
                rows = [ids[i:j].tobytes() for i, j in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["doc_id", "terms"])

    return in_arrow(spread(worded(documents)), run, "doc_id long, terms binary").filter(F.length("terms") > 0)


def phrases(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """One number for the n words from each place on; 0 where a text ends before."""
    h = np.zeros(len(words), np.uint64)
    for j in range(n):
        h[: len(words) - j] = (h[: len(words) - j] ^ words[j:]) * np.uint64(0x9E3779B97F4A7C15)
        h[: len(words) - j] ^= h[: len(words) - j] >> np.uint64(31)
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(words))
    h[left < n] = 0
    return h


def short_leaks(documents: DataFrame, items: list[tuple[int, np.ndarray]]) -> DataFrame:
    """Leaks of short items, given as (item_id, 32 bits of each word): the whole of their words in a row."""
    shared = documents.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[int, dict[int, list[int]]] = {}
        for item_id, words in shared.value:
            h = int(phrases(words, np.array([0, len(words)]), len(words))[0])
            wanted.setdefault(len(words), {}).setdefault(h, []).append(item_id)
        for batch in batches:
            for b in chunks(batch):
                words, starts = hashed_words(b.column(1).to_pylist())
                rows = set()
                for n, by in wanted.items():
                    h = phrases(words, starts, n)
                    for at in np.flatnonzero(np.isin(h, np.array(list(by), np.uint64))):
                        d = int(np.searchsorted(starts, at, "right")) - 1
                        rows.update((b.column(0)[d].as_py(), i, n) for i in by[int(h[at])])
                if rows:
                    ids, which, n = zip(*sorted(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(which), pa.array(np.ones(len(ids))), pa.array(n), pa.array(n)], names=["doc_id", "item_id", "cosine", "common", "words"])

    return in_arrow(spread(worded(documents)), run, LEAKS)


def texts(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in b.column(b.schema.get_field_index("terms")).to_pylist()]


def frequencies(terms: DataFrame) -> np.ndarray:
    """In how many documents each term occurs; the last number counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for b in chunks(batch, "terms"):
                for d in texts(b):
                    total[np.unique(d)] += 1
                total[-1] += b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    got = in_arrow(terms, run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # 2**BITS + 1 rows at most
    out = np.zeros(TERMS + 1, np.int64)
    out[got["term"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def rarest(benchmark: DataFrame, counts: np.ndarray) -> np.ndarray:
    """The terms that are among the TELLING rarest of any item."""
    out = np.zeros(TERMS, bool)
    for held in benchmark_slices(benchmark):
        for _, words in held:
            own = np.unique(folded(words))
            out[own[np.argsort(counts[own], kind="stable")[:TELLING]]] = True
    return out


def weights(counts: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Inverse document frequency; 0 for stop terms, those in more than a share COMMON of the documents.

    The rarest terms of each item are never stop terms, so that an item of common words can be found too.
    """
    n, df = counts[-1], counts[:-1]
    w = np.log1p(n / (df + 0.5)).astype(np.float32)
    w[(df > COMMON * n + 10) & ~telling] = 0
    w[0] = 0
    return w


def sums(table_: np.ndarray, ids: np.ndarray, keep: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows that ids name between starts, of those to keep."""
    kept = np.flatnonzero(keep)
    at = np.searchsorted(kept, starts)
    full = np.flatnonzero(np.diff(np.append(at, len(kept))))
    out = np.zeros((len(starts), table_.shape[1]), np.float32)
    if len(full):
        out[full] = np.add.reduceat(table_[ids[kept]], at[full], axis=0)
    return out


def blocks(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and number within the document of each block of size words."""
    n = -(-lengths // size)
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, (np.cumsum(lengths) - lengths)[doc] + k * size, k


def block_sums(table_: np.ndarray, ids: np.ndarray, starts: np.ndarray, out: np.ndarray, place: np.ndarray) -> None:
    """Puts the sums of the rows that the words of each block name at the block's place in out; row 0 is zero."""
    lengths = np.diff(starts)
    doc, first, _ = blocks(lengths, BLOCK)
    stop = starts[1:][doc]
    for low in range(0, len(doc), 1024):
        f, z = first[low : low + 1024], stop[low : low + 1024]
        total = table_[ids[f]]
        for j in range(1, BLOCK):
            total += table_[np.where(f + j < z, ids[np.minimum(f + j, len(ids) - 1)], 0)]
        out[place[low : low + 1024]] = total


def gaussian(rows: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(rows, RANK + EXTRA)).astype(np.float32)


def gram_times_gaussian(terms: DataFrame, w: np.ndarray) -> np.ndarray:
    """A'A times a Gaussian block, A being the passages of all documents as unit TF-IDF rows."""
    shared = terms.sparkSession.sparkContext.broadcast(w)
    part = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        weighted = gaussian(TERMS) * w[:, None]
        squares = (w * w)[:, None]
        z = np.zeros_like(weighted)
        for batch in batches:
            for b in chunks(batch, "terms"):
                ids, starts = ragged(texts(b))
                _, first, _ = blocks(np.diff(starts), PASSAGE)
                keep = w[ids] > 0
                y = sums(weighted, ids, keep, first) / np.maximum(sums(squares, ids, keep, first), 1e-6)
                kept = np.flatnonzero(keep)
                if not len(kept):
                    continue
                passage = np.searchsorted(first, kept, "right") - 1
                order = np.argsort(ids[kept], kind="stable")
                sorted_ids = ids[kept][order]
                at = np.append(0, 1 + np.flatnonzero(np.diff(sorted_ids)))
                z[sorted_ids[at]] += np.add.reduceat(y[passage[order]], at, axis=0)
        z *= w[:, None]
        n = TERMS // part
        team = TaskContext.get().partitionId() // TEAM
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, team, np.int32)), pa.array([z[i : i + part].tobytes() for i in range(0, TERMS, part)], pa.binary())], names=["part", "team", "z"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros((part, RANK + EXTRA))
        for x in t.column("z").to_pylist():
            total += np.frombuffer(x, np.float32).reshape(total.shape)
        return pa.table({"part": t.column("part").slice(0, 1), "team": t.column("team").slice(0, 1), "z": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    kinds = "part int, team int, z binary"
    # in two steps, so that no task adds up more than TEAM or tasks / TEAM blocks; 2**BITS x (RANK + EXTRA) numbers come back
    got = in_arrow(terms, run, kinds).groupBy("part", "team").applyInArrow(add, kinds).groupBy("part").applyInArrow(add, kinds).toPandas()
    z = np.zeros((TERMS, RANK + EXTRA), np.float32)
    for i, x in zip(got["part"], got["z"]):
        z[i * part : (i + 1) * part] = np.frombuffer(x, np.float32).reshape(part, -1)
    return z


def latent_map(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What each term adds to a passage's latent vector: its weight times its row of the right singular vectors."""
    omega = gaussian(TERMS).astype(np.float64)
    z = z.astype(np.float64)
    shift = 1e-6 * max(np.linalg.norm(z), 1e-12)
    z = z + shift * omega
    core = omega.T @ z
    u, s, _ = np.linalg.svd((core + core.T) / 2)
    half = u / np.sqrt(np.maximum(s, s[0] * 1e-12))
    v, sigma, _ = np.linalg.svd(z @ half, full_matrices=False)
    value = np.maximum(sigma**2 - shift, 0)
    good = np.flatnonzero(value > 1e-6 * max(value[0], 1e-12))[:RANK]
    return np.ascontiguousarray(w[:, None] * v[:, good], np.float32)  # rows side by side, as they are read by row


class Item:
    """An item's words, ready for the check."""

    def __init__(self, item_id: int, ids: np.ndarray, w: np.ndarray):
        self.item_id, self.n = item_id, len(ids)
        self.masks: dict[int, int] = {}
        for k, x in enumerate(ids.tolist()):
            self.masks[x] = self.masks.get(x, 0) | (1 << k)
        told = [x for x in ids.tolist() if w[x] > 0]
        self.answer = set(told[-ANSWER:])
        self.ids = ids.tolist()

    def common(self, words: list[int]) -> int:
        """Length of the longest common subsequence, by bits."""
        full = (1 << self.n) - 1
        v, get = full, self.masks.get
        for x in words:
            m = get(x)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return self.n - v.bit_count()

    def found(self, words: list[int], distinct: set[int]) -> tuple[bool, int]:
        if sum(map(distinct.__contains__, self.ids)) < PARAPHRASE * self.n:  # no subsequence can be longer
            return False, 0
        n = self.common(words)
        if n >= VERBATIM * self.n:
            return True, n
        there = len(self.answer & distinct)
        return bool(n >= PARAPHRASE * self.n and self.answer and there >= ANSWER_SHARE * len(self.answer)), n


class Places:
    """Which places of some items each word takes, as one bit of a 64-bit lane for each place."""

    def __init__(self, items: list[tuple[int, np.ndarray]], numbers: np.ndarray):
        self.numbers = numbers[np.argsort([len(items[k][1]) for k in numbers], kind="stable")]  # those of one reach side by side
        words = [items[k][1] for k in self.numbers]
        self.n = np.array([len(x) for x in words])
        self.lane = np.append(0, np.cumsum(-(-self.n // 64)))
        self.reach = -(-(2 * self.n + 2 * BLOCK) // BLOCK) + 1  # in blocks, from every other block on
        vocabulary = np.unique(np.concatenate(words))
        self.row = np.zeros(TERMS, np.int32)
        self.row[vocabulary] = 1 + np.arange(len(vocabulary))
        self.table = np.zeros((1 + len(vocabulary), self.lane[-1]), np.uint64)
        for first, x in zip(self.lane, words):
            k = np.arange(len(x))
            np.bitwise_or.at(self.table, (self.row[x], first + k // 64), np.uint64(1) << (k % 64).astype(np.uint64))

    def stretches(self, rows: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Reach, blocks and items of all stretches that hold PARAPHRASE of an item's places."""
        lengths = np.diff(starts)
        doc, first, k = blocks(lengths, BLOCK)
        total = (-(-lengths // BLOCK))[doc]
        at = first[:, None] + np.arange(BLOCK)
        each = np.where(at < starts[1:][doc][:, None], rows[np.minimum(at, len(rows) - 1)], 0)
        most, least = int(self.reach.max()), np.ceil(PARAPHRASE * self.n - 1e-9).astype(np.int64)
        reaches, begin = np.unique(self.reach, return_index=True)
        for low in range(0, len(doc), STRETCH):
            part = each[low : low + STRETCH + most]
            m = np.zeros((STRETCH + most, self.table.shape[1]), np.uint64)
            here = m[: len(part)]
            for j in range(BLOCK):
                here |= self.table[part[:, j]]
            ks, totals = k[low : low + STRETCH], total[low : low + STRETCH]
            for r, b, e in zip(reaches, begin, np.append(begin[1:], len(self.n))):
                some = np.flatnonzero((ks % 2 == 0) & (ks < np.maximum(totals - r + 2, 1)))
                x, size = m[:, self.lane[b] : self.lane[e]], 1
                while 2 * size <= r:
                    x, size = x[:-size] | x[size:], 2 * size
                held = np.bitwise_count(x[some] | x[some + r - size])
                if self.lane[e] - self.lane[b] > e - b:
                    held = np.add.reduceat(held, self.lane[b:e] - self.lane[b], axis=1, dtype=np.int64)
                i, c = np.nonzero(held >= least[b:e])
                if len(i):
                    yield int(r), low + some[i], b + c

    def common(self, rows: np.ndarray, first: np.ndarray, stop: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Longest common subsequences of stretches of words with items of one lane."""
        lane, one = self.lane[item], ~np.uint64(0)
        v = np.full(len(item), one)
        for step in range(int((stop - first).max()) if len(item) else 0):
            at = first + step
            u = v & self.table[np.where(at < stop, rows[np.minimum(at, len(rows) - 1)], 0), lane]
            v = (v + u) | (v - u)
        n = self.n[item]
        return n - np.bitwise_count(v & (one >> (64 - n).astype(np.uint64))).astype(np.int64)

    def found(self, ids: np.ndarray, starts: np.ndarray, done: set[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """Document, item's number, first and last word, and common words, -1 if not counted, of all stretches to check; not of pairs that are done."""
        if not len(ids):
            return
        rows = self.row[ids]
        doc, first, _ = blocks(np.diff(starts), BLOCK)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def checked() -> Iterator[tuple[int, int, int, int, int]]:
            i, c, r = (np.concatenate(x) for x in zip(*held))
            held.clear()
            a = first[i]
            z = np.minimum(a + r * BLOCK, starts[1:][doc[i]])
            n = np.full(len(c), -1)
            one = np.flatnonzero(self.n[c] <= 64)
            if len(one):
                n[one] = self.common(rows, a[one], z[one], c[one])
            some = np.flatnonzero((n >= PARAPHRASE * self.n[c]) | (n < 0))
            yield from zip(doc[i[some]].tolist(), self.numbers[c[some]].tolist(), a[some].tolist(), z[some].tolist(), n[some].tolist())

        for r, i, c in self.stretches(rows, starts):
            if done:
                left = np.array([x not in done for x in zip(doc[i].tolist(), self.numbers[c].tolist())])
                i, c = i[left], c[left]
            held.append((i, c, np.full(len(i), r)))
            if sum(len(x) for x, _, _ in held) >= PAIRS:
                yield from checked()
        if held:
            yield from checked()


def item_pieces(items: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """(number of the item, terms) of pieces of at most PASSAGE words."""
    out = []
    for k, (_, ids) in enumerate(items):
        out += [(k, p) for p in np.array_split(ids, -(-len(ids) // PASSAGE))]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def benchmark_slices(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as (item_id, 32 bits of each word), a bounded number at a time, in the order of ids."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        words = hashed_words([r.text])[0]
        if not len(words):
            continue
        if held and (len(held) == SLICE or size + len(words) > SLICE_WORDS):
            yield held
            held, size = [], 0
        held.append((r.item_id, words))
        size += len(words)
    if held:
        yield held


def search(terms: DataFrame, items: list[tuple[int, np.ndarray]], latent: np.ndarray, w: np.ndarray) -> DataFrame:
    """(doc_id, item_id, cosine, common, words) of the leaks of these items."""
    cut = item_pieces(items)
    vectors = unit(np.stack([latent[p].sum(0) for _, p in cut]))
    sizes = np.array([-(-len(p) // BLOCK) + 1 for _, p in cut])
    owner = np.array([k for k, _ in cut])
    shared = terms.sparkSession.sparkContext.broadcast((items, latent, w, vectors, sizes, owner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, latent, w, vectors, sizes, owner = shared.value
        ready: dict[int, Item] = {}
        groups: list[Places] = []
        held = np.cumsum([-(-len(x) // 64) for _, x in items])
        for g in np.unique((held - 1) // LANES):
            groups.append(Places(items, np.flatnonzero((held - 1) // LANES == g)))

        def ready_item(number: int) -> Item:
            if number not in ready:
                ready[number] = Item(*items[number], w)
            return ready[number]

        def closest(words: np.ndarray, number: int) -> float:
            """Greatest cosine of an item's piece with a window of the words."""
            s = latent[words] * (w[words] > 0)[:, None]
            total = np.concatenate([np.zeros((1, s.shape[1])), np.cumsum(s, 0, dtype=np.float64)])
            best = -1.0
            for piece in np.flatnonzero(owner == number):
                size = min(int(sizes[piece]) * BLOCK, len(words))
                best = max(best, float((unit(total[size:] - total[:-size]) @ vectors[piece]).max()))
            return best
        gap = int(sizes.max()) - 1

        def read(b: pa.RecordBatch) -> Iterator[tuple[int, int, float, int, int]]:
            docs = texts(b)
            ids, starts = ragged(docs)
            doc, first, k = blocks(np.diff(starts), BLOCK)
            s = np.zeros((len(doc) + gap * len(docs), latent.shape[1]), np.float32)
            place = np.arange(len(doc)) + gap * doc
            block_sums(latent, ids, starts, s, place)
            near: list[tuple[np.ndarray, ...]] = []
            t = s.copy()
            for n in range(2, gap + 2):
                t[: len(t) - n + 1] += s[n - 1 :]
                cols = np.flatnonzero(sizes == n)
                if not len(cols):
                    continue
                rows = np.flatnonzero(k % 2 == 0)
                for at in range(0, len(rows), 8192):
                    some = rows[at : at + 8192]
                    x = t[place[some]]
                    length = np.sqrt(np.einsum("ij,ij->i", x, x)) + 1e-9
                    dot = x @ vectors[cols].T
                    i, c = np.nonzero(dot >= COSINE * length[:, None])
                    near.append((some[i], owner[cols[c]], dot[i, c] / length[i], np.full(len(i), n)))
            r, it, cos, n = (np.concatenate(x) for x in zip(*near))
            done: set[tuple[int, int]] = set()
            order = np.argsort(-cos, kind="stable")
            # the closest window of a document and an item; the others' words are among the stretches below
            order = order[np.unique(doc[r[order]] * len(items) + it[order], return_index=True)[1]]
            for i in order:
                pair = (int(doc[r[i]]), int(it[i]))
                item = ready_item(pair[1])
                d, at = docs[pair[0]], int(k[r[i]]) * BLOCK
                around = d[max(0, at - item.n // 2) : at + max(int(n[i]) * BLOCK, item.n) + item.n // 2].tolist()
                leak, common = item.found(around, set(around))
                if leak:
                    done.add(pair)
                    yield b.column(0)[pair[0]].as_py(), item.item_id, float(cos[i]), common, item.n
            for g in groups:
                for d, number, first_word, end, common in g.found(ids, starts, done):
                    if (d, number) in done:
                        continue
                    item, words = ready_item(number), ids[first_word:end]
                    leak = common >= VERBATIM * item.n
                    if not leak:
                        leak, common = item.found(words.tolist(), set(words.tolist()))
                    if leak:
                        done.add((d, number))
                        yield b.column(0)[d].as_py(), item.item_id, closest(words, number), common, item.n

        for batch in batches:
            for b in chunks(batch, "terms"):
                if rows := list(read(b)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["doc_id", "item_id", "cosine", "common", "words"])

    return in_arrow(terms, run, LEAKS)


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common (words in order), words (of the item): one row for each leak."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    found = spark.createDataFrame([], LEAKS)
    terms = counts = latent = None
    for held in benchmark_slices(benchmark):
        if short := [x for x in held if len(x[1]) < SHORT]:
            found = found.union(short_leaks(documents, short))
        items = [(i, folded(w)) for i, w in held if len(w) >= SHORT]
        if not items:
            continue
        if terms is None:
            terms = scratch.save(term_table(documents), "terms")
            counts = frequencies(terms)
            telling = rarest(benchmark, counts)
            w = weights(counts, telling)
            latent = latent_map(gram_times_gaussian(terms, w), w) if counts[-1] else None
        if latent is not None:
            found = found.union(search(terms, items, latent, w))
    best = found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("common").alias("common"), F.max("words").alias("words"))
    out = scratch.save(best, "leaks")
    if terms is not None:
        scratch.remove(terms)
    return out


def drop_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that hold no benchmark item, all columns as they came."""
    gone = leaks(documents, benchmark).select(F.col("doc_id").alias("__gone")).distinct()
    return documents.join(gone, documents.doc_id == F.col("__gone"), "left_anti")


def leaked_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
