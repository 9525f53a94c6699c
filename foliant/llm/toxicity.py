"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of three rows of a hashed table: of the word itself and of its first four and five letters.
Filters of several widths slide over the word vectors, the largest value of each filter over the whole text is kept
(max pooling), and a logistic layer gives the score. Only the fit uses a bounded sample of the labelled rows (`Fit`);
scoring covers every word of every document, once. Thresholds are calibrated by language on the scores of all labelled rows
that the fit didn't learn from, summed by Spark in a histogram: each language and class weighs there what it weighs among
all labelled rows, and the threshold is that of best F1. A language with too few such toxic rows gets the threshold of all
languages together. The histogram's rows are languages with labels x 2 classes x BINS at most.

Defined results: a null or wordless text has a null score and is never toxic; a null or unseen language uses the common
threshold; labels that are null, or whose document is missing, are ignored; a doc_id with several labels counts as toxic if
any says so; without labels of both kinds nothing is toxic. Repeated rows are each scored alike, and other columns of the input are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, Words, bounded_sample, chunks, hash32, in_arrow, numbers, pieces, spread, table, word

PARTS = 3
ODDS = "__odds__"
BINS, WIDTH = 960, 16  # of the log odds from -30 to 30, and how many to one


@dataclass(frozen=True)
class Fit:
    per_class: int = 500  # labelled documents of each language and class at most
    longest: int = 20_000  # words; longer documents are left out of the fit, never out of the scoring
    held_out: float = 0.3
    own_threshold: int = 15  # toxic held-out documents from which a language has its own threshold
    buckets: int = 1 << 15
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6
    rate: float = 0.02
    seed: int = 7


def parts(raw: str, buckets: int) -> tuple[int, int, int] | None:
    """The rows of the embedding table that make up a word's vector; row 0 is the padding between documents."""
    w = word(raw)
    if not w:
        return None
    return tuple(1 + hash32(x) % (buckets - 1) for x in (f"w{w}", f"4{w[:4]}", f"5{w[:5]}"))


class Model:
    """Parameters and numpy passes of the network."""

    def __init__(self, fit: Fit, odds: np.ndarray):
        r = np.random.default_rng(fit.seed)
        self.fit = fit
        self.E = r.normal(0, 0.05, (fit.buckets, fit.dim)).astype(np.float32)
        self.E[:, 0] = odds  # the log odds of each bucket in the sample start the first dimension
        self.E[0] = 0
        self.W = {w: r.normal(0, 0.15, (w, fit.dim, fit.filters)).astype(np.float32) for w in fit.widths}
        for w in self.W.values():
            w[0, 0, : fit.filters // 2] += 0.5
        self.b = np.zeros(len(fit.widths) * fit.filters, np.float32)
        self.v = np.full(len(fit.widths) * fit.filters, 0.2, np.float32)
        self.c = np.zeros(1, np.float32)
        self.seen: list[int] = []  # documents that it has learnt from

    def arrays(self) -> list[np.ndarray]:
        return [self.E, *self.W.values(), self.b, self.v, self.c]

    def forward(self, X: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled values and the positions they come from, by document and filter."""
        pooled, at = [], []
        for w, k in self.W.items():
            z = X @ k[0]
            for j in range(1, w):
                z[:-j] += X[j:] @ k[j]
            p = np.stack([z[s:e].argmax(0) + s for s, e in zip(starts, starts[1:])])
            at.append(p)
            pooled.append(np.take_along_axis(z, p, 0))
        return np.concatenate(pooled, 1) + self.b, np.concatenate(at, 1)

    def step(self, ids: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        f = self.fit
        X = self.E[ids].sum(1)
        pre, at = self.forward(X, starts)
        h = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ self.v + self.c, -30, 30)))
        g = ((p - y) * weight / len(y)).astype(np.float32)
        dh = g[:, None] * self.v * (pre > 0)
        dE, dW = np.zeros_like(self.E), []
        for k, (w, kernel) in enumerate(self.W.items()):
            own, pos = dh[:, k * f.filters : (k + 1) * f.filters], at[:, k * f.filters : (k + 1) * f.filters]
            d = np.zeros_like(kernel)
            for j in range(w):
                q = np.minimum(pos + j, len(X) - 1)
                d[j] = np.einsum("nf,nfd->df", own, X[q])
                dx = own[:, :, None] * kernel[j].T[None]
                for part in range(PARTS):
                    np.add.at(dE, ids[q, part], dx)
            dW.append(d)
        dE[0] = 0
        return [dE, *dW, dh.sum(0), h.T @ g, np.array([g.sum()], np.float32)]

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(docs), np.nan, np.float32)
        for i in range(0, len(docs), 64):
            some = [k for k in range(i, min(i + 64, len(docs))) if len(docs[k])]
            if some:
                ids, starts = joined([docs[k] for k in some], max(self.fit.widths))
                pre, _ = self.forward(self.E[ids].sum(1), starts)
                out[some] = self.probability(pre)
        return out

    def odds(self, pooled: np.ndarray) -> np.ndarray:
        """Log odds."""
        return np.clip(np.maximum(pooled, 0) @ self.v + self.c, -30, 30)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(pooled)))


def joined(docs: list[np.ndarray], widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents end to end with padding after each, so that no filter sees two of them."""
    pad = np.zeros((widest - 1, PARTS), np.int32)
    ids = np.concatenate([x for d in docs for x in (d, pad)])
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) + len(pad) for d in docs], out=starts[1:])
    return ids, starts


def separate(toxic: np.ndarray, clean: np.ndarray) -> float:
    """From the weight of either class in each bin, the log odds of best F1, in the middle of the gap that it lies in."""
    t, c = np.cumsum(toxic[::-1])[::-1], np.cumsum(clean[::-1])[::-1]
    f1 = 2 * t / (t + c + t[0])
    some = np.flatnonzero(toxic + clean)
    k = int(some[::-1][f1[some][::-1].argmax()])  # of equals the highest
    below = some[some < k]
    low = below[-1] + 1 if len(below) else k
    return float((k + low) / 2 / WIDTH - BINS / WIDTH / 2)


def train(docs: list[np.ndarray], y: np.ndarray, fit: Fit, ids: list[int] | None = None) -> Model:
    """Fits on a part of the rows; rows are taken in the order given."""
    docs, keep = [d for d in docs if len(d)], [k for k, d in enumerate(docs) if len(d)]
    y = np.asarray(y, np.float32)[keep]
    r = np.random.default_rng(fit.seed)
    held = r.random(len(docs)) < fit.held_out
    seen = np.flatnonzero(~held)
    count = np.zeros((2, fit.buckets), np.float32)
    for k in seen:
        count[int(y[k]), np.unique(docs[k])] += 1
    n1 = max(1.0, y[seen].sum())
    n0 = max(1.0, len(seen) - y[seen].sum())
    odds = np.log((count[1] + 0.3) / (n1 + 1)) - np.log((count[0] + 0.3) / (n0 + 1))
    odds[count.sum(0) == 0] = 0
    model = Model(fit, np.clip(odds * np.minimum(1, count.sum(0) / 3), -1.5, 4).astype(np.float32) / 3)
    if not 0 < y[seen].sum() < len(seen):
        return model
    model.seen = [] if ids is None else [ids[keep[k]] for k in seen]
    weight = np.where(y == 1, 0.5 * len(seen) / n1, 0.5 * len(seen) / n0)
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in model.arrays()]
    t = 0
    for _ in range(fit.epochs):
        order = r.permutation(seen)
        for i in range(0, len(order), 32):
            some = order[i : i + 32]
            ids, starts = joined([docs[k] for k in some], max(fit.widths))
            t += 1
            grads = model.step(ids, starts, y[some], weight[some])
            for k, (a, g, (m, v)) in enumerate(zip(model.arrays(), grads, moments)):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                a -= fit.rate * (0.25 if k == 0 else 1) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return model


def marked(labels: DataFrame) -> DataFrame:
    """doc_id and whether any label calls it toxic."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))


def training_rows(documents: DataFrame, labels: DataFrame, fit: Fit) -> tuple[list, np.ndarray, list[int]]:
    """Rows, labels and ids of the bounded sample, made into embedding rows by the executors. The ids it is picked by number
    2 x languages x per_class at most, hence the broadcast."""
    ids = documents.select(F.col("doc_id").alias("doc_id"), "lang").filter("doc_id is not null").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    picked = bounded_sample(ids.join(marked(labels), "doc_id"), ["lang", "toxic"], "doc_id", fit.per_class, fit.seed)
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    buckets, longest = fit.buckets, fit.longest

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                rows = []
                for text in b.column(3).to_pylist():
                    w = [p for x in pieces(text or "") for raw in x.split() if (p := parts(raw, buckets))]
                    rows.append(np.array(w, np.int32).tobytes() if 0 < len(w) <= longest else b"")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rows, pa.binary())], names=["doc_id", "lang", "toxic", "rows"])

    got = in_arrow(texts.select(F.col("doc_id").cast("long"), "lang", "toxic", "text"), read, "doc_id long, lang string, toxic int, rows binary").toPandas()
    got = got[got["rows"].map(len) > 0].sort_values(["doc_id", "rows"], kind="stable").drop_duplicates("doc_id")
    return [np.frombuffer(x, np.int32).reshape(-1, PARTS) for x in got["rows"]], got["toxic"].to_numpy(), got["doc_id"].tolist()


def fit_model(documents: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    docs, y, ids = training_rows(documents, labels, fit)
    return train(docs, y, fit, ids)


class Scorer:
    """Scores texts in a worker: a word's part in every filter is worked out once, then a text only adds and compares rows."""

    def __init__(self, model: Model, limit: int = 150_000):
        f = self.fit = model.fit
        self.model, self.limit = model, limit
        kernel = np.concatenate([k[j] for k in model.W.values() for j in range(len(k))], 1)
        self.columns = [(w, j) for w in f.widths for j in range(w)]
        self.kernel = kernel
        self.reset()

    def reset(self) -> None:
        self.new: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.size, self.rows = 0, np.zeros((4096, self.kernel.shape[1]), np.float32)
        self.words = Words(self.number, limit=1 << 62)

    def number(self, raw: str) -> int:
        p = parts(raw, self.fit.buckets)
        if p is None:
            return 0
        self.new.append(p)
        return self.size + len(self.new) - 1

    def settle(self) -> None:
        if not self.new:
            return
        want = self.size + len(self.new)
        if want > len(self.rows):
            bigger = np.zeros((max(want, 2 * len(self.rows)), self.rows.shape[1]), np.float32)
            bigger[: self.size] = self.rows[: self.size]
            self.rows = bigger
        self.rows[self.size : want] = self.model.E[np.array(self.new)].sum(1) @ self.kernel
        self.size, self.new = want, []

    def pool(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        f, m = self.fit.filters, len(ids)
        z = self.rows[ids]
        out, at = [], 0
        for w in self.fit.widths:
            s = z[:, at : at + f]
            for j in range(1, w):
                s = s.copy() if j == 1 else s
                s[: m - j] += z[j:, at + j * f : at + (j + 1) * f]
            out.append(np.maximum.reduceat(s, starts, axis=0))
            at += w * f
        return np.concatenate(out, 1)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.size > self.limit:
            self.reset()
        docs = [numbers(t, self.words) if t else np.zeros(0, np.uint32) for t in texts]
        self.settle()
        out = np.full(len(docs), np.nan, np.float32)
        some = [k for k, d in enumerate(docs) if len(d)]
        if not some:
            return out
        pad, span = max(self.fit.widths) - 1, 1 << 15
        best: dict[int, np.ndarray] = {}
        run: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if run:
                gap = np.zeros(pad, np.uint32)
                ids = np.concatenate([x for _, d in run for x in (d, gap)])
                starts = np.cumsum([0] + [len(d) + pad for _, d in run[:-1]])
                for (k, _), p in zip(run, self.pool(ids, starts)):
                    best[k] = np.maximum(best[k], p) if k in best else p
                run.clear()

        held = 0
        for k in some:
            d = docs[k]
            step = span
            for i in range(0, len(d), step):  # long texts in spans that overlap by a filter's width
                part = d[i : i + step + pad] if i + step < len(d) else d[i:]
                run.append((k, part))
                held += len(part)
                if held >= span:
                    flush()
                    held = 0
        flush()
        out[some] = self.model.odds(np.stack([best[k] for k in some]) + self.model.b)
        return out


def scored(documents: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """Those columns of documents, and the log odds of each row's text in ODDS."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few megabytes, whatever the corpus
    name = ODDS
    while name in documents.columns:
        name += "_"
    rows = documents.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias(name))
    kept = len(columns)
    schema = T.StructType([*rows.schema.fields[:kept], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for b in chunks(batch, name):
                s = scorer(b.column(kept).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(s.astype(np.float64), mask=np.isnan(s))], names=b.schema.names)

    return in_arrow(spread(rows), run, schema)


def thresholds(odds: DataFrame, labels: DataFrame, model: Model, fit: Fit) -> dict[str | None, float]:
    """Log odds from which a language's documents are toxic, None standing for all others; from (doc_id, lang, odds) of all documents."""
    spark = odds.sparkSession
    if not model.seen:
        return {None: float("inf")}
    one = odds.filter("doc_id is not null and odds is not null").groupBy("doc_id").agg(F.min("lang").alias("lang"), F.max("odds").alias("odds"))
    learnt = spark.createDataFrame([(i,) for i in model.seen], "seen long")  # no more than the fit's sample
    rows = one.join(marked(labels), "doc_id").join(F.broadcast(learnt), F.col("doc_id") == F.col("seen"), "left").withColumn("free", F.col("seen").isNull())
    at = F.least(F.lit(BINS - 1), F.floor((F.col("odds") + BINS / WIDTH / 2) * WIDTH).cast("int"))
    got = rows.groupBy("lang", "toxic", "free", at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    if not set(got["toxic"]) == {0, 1} == set(got["toxic"][got["free"]]):
        got["free"] = True  # nothing was held out, so what was learnt from has to do
    tables: dict[str | None, np.ndarray] = {}
    toxic: dict[str | None, int] = {}
    got["lang"] = [x if isinstance(x, str) else None for x in got["lang"]]
    for (lang, y), part in got.groupby(["lang", "toxic"], dropna=False):
        lang = lang if isinstance(lang, str) else None
        free = part[part["free"]]
        h = np.bincount(free["bin"], free["n"], BINS) if len(free) else np.bincount(part["bin"], part["n"], BINS)
        tables.setdefault(lang, np.zeros((2, BINS)))[y] += h * part["n"].sum() / h.sum()
        toxic[lang] = toxic.get(lang, 0) + int(free["n"].sum()) * int(y)
    out = {k: separate(h[1], h[0]) for k, h in tables.items() if k is not None and toxic[k] >= fit.own_threshold and h[0].sum() > 0}
    every = sum(tables.values())
    return {**out, None: separate(every[1], every[0])}


def threshold(limits: dict[str | None, float]) -> Column:
    """That of a row's `lang`."""
    named = [x for k, v in limits.items() if k is not None for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*named)[F.col("lang")], F.lit(limits[None])) if named else F.lit(limits[None])


def score(documents: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """doc_id, lang, score, threshold, toxic for every row of documents."""
    model = fit_model(documents, labels, fit)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    odds = Scratch(documents.sparkSession).save(scored(rows, model, ["doc_id", "lang"]).withColumnRenamed(ODDS, "odds"), "odds")
    limits = thresholds(odds, labels, model, fit)
    chance = lambda x: 1 / (1 + F.exp(-x))
    return odds.select("doc_id", "lang", chance(F.col("odds")).alias("score"), chance(threshold(limits)).alias("threshold"), F.coalesce(F.col("odds") >= threshold(limits), F.lit(False)).alias("toxic"))


def reject_toxic(documents: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """The rows of documents that are not toxic, all columns as they came.

    They are written with their odds, so that texts are scored once and no join has to bring rows and decisions together.
    """
    model = fit_model(documents, labels, fit)
    both = Scratch(documents.sparkSession).save(scored(documents, model, documents.columns), "odds")
    name = both.columns[-1]
    odds = both.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col(name).alias("odds"))
    limits = thresholds(odds, labels, model, fit)
    return both.filter(~F.coalesce(F.col(f"`{name}`") >= threshold(limits), F.lit(False))).drop(name)


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the classifier rejects, with its score and the threshold of its language."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).filter("toxic")
