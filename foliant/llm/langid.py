"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier (logistic, over hashed letter n-grams of the whole
text) says which half of the languages a text is in. Decoding weighs each bit's loss by how well that bit does on held-out
texts of that language and takes the language of least loss; a text whose second-best language is nearly as good is
flagged as ambiguous. Only the fit uses a bounded sample of the labelled rows (`Fit`); every character of every text is
scored, long texts in pieces whose counts add up.

Defined results: a null text, or one without a letter, has a null language and is ambiguous. Rows with a null label aren't
learnt from but are identified. Case doesn't count. With one known language every text with letters is in it; with none
the language is null. Ties go to the language that sorts first. Repeated rows are identified alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, chunks, in_arrow, spread, table

D = 4096
ORDERS = (1, 2, 3)
SPAN = 1 << 18  # characters counted at once
_K = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


@dataclass(frozen=True)
class Fit:
    per_language: int = 400  # labelled documents at most
    held_out: float = 0.25
    bits: int = 15  # length of the codewords, or four times the binary logarithm of the languages if that is more
    steps: int = 150
    rate: float = 4.0
    decay: float = 1e-5
    doubtful: float = 0.02  # share of rightly identified held-out texts that may be flagged
    seed: int = 5


def counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts of each text, in lower case, with digits, punctuation and white space all alike."""
    out = np.zeros((len(texts), D), np.float32)
    run: list[tuple[int, np.ndarray, int]] = []
    held, overlap = 0, ORDERS[-1] - 1

    def flush() -> None:
        if not run:
            return
        c = np.concatenate([x for _, x, _ in run])
        own = np.repeat([k for k, _, _ in run], [len(x) for _, x, _ in run])
        starts = np.concatenate([np.arange(len(x)) < limit for _, x, limit in run])
        base = own[0]
        cells = (own - base) * D
        h = c * _K[0]
        for n in ORDERS:
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _K[1] + c[n - 1 :] * _K[n - 1]
            m = len(h)
            good = starts[:m] & (own[:m] == own[n - 1 :])
            cell = cells[:m] + ((h * _K[3]) >> np.uint32(20))
            got = np.bincount(cell[good])
            out.reshape(-1)[base * D : base * D + len(got)] += got
        run.clear()

    for k, text in enumerate(texts):
        code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
        code = np.where(code < 65, np.uint32(32), code)
        for at in range(0, len(code), SPAN):
            run.append((k, code[at : at + SPAN + overlap], SPAN))
            held += len(run[-1][1])
            if held >= SPAN:
                flush()
                held = 0
    flush()
    return out


def features(texts: list[str]) -> np.ndarray:
    x = np.sqrt(counts(texts))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(languages: int, bits: int, seed: int) -> np.ndarray:
    """Of many random codes, the one whose two nearest codewords lie furthest apart; every bit tells some languages apart."""
    bits = max(bits, 4 * int(np.ceil(np.log2(max(2, languages)))))
    r = np.random.default_rng(seed)
    best, code = -1, np.ones((languages, bits), np.int8)
    for _ in range(300 if languages > 1 else 0):
        c = r.choice(np.array([-1, 1], np.int8), (languages, bits))
        for j in np.flatnonzero(np.abs(c.sum(0)) == languages):
            c[r.integers(languages), j] *= -1
        apart = (bits - c.astype(int) @ c.T.astype(int)) // 2
        least = (apart + 10**6 * np.eye(languages, dtype=int)).min()
        if least > best:
            best, code = least, c
    return code


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, W: np.ndarray, b: np.ndarray):
        self.languages, self.code, self.W, self.b = languages, code, W, b
        self.trust = np.full(code.shape, 1 / max(1, code.shape[1]))
        self.doubt = 0.0

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of each text for each language."""
        f = np.clip(x @ self.W + self.b, -6, 6)
        return np.stack([np.log1p(np.exp(-f * c)) @ t for c, t in zip(self.code, self.trust)], 1)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number, its loss, and by what share of it the second is worse."""
        loss = self.losses(x)
        order = np.argsort(loss, 1, kind="stable")
        at = np.arange(len(x))
        best = loss[at, order[:, 0]]
        second = loss[at, order[:, 1]] if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return order[:, 0], best, (second - best) / np.maximum(best + second, 1e-9) if loss.shape[1] > 1 else np.ones(len(x))


def train(x: np.ndarray, lang: list[str], fit: Fit) -> Model:
    names = sorted(set(lang))
    y = np.array([names.index(v) for v in lang], int)
    code = codewords(len(names), fit.bits, fit.seed)
    model = Model(names, code, np.zeros((D, code.shape[1])), np.zeros(code.shape[1]))
    if len(names) < 2:
        return model
    held = np.random.default_rng(fit.seed).random(len(y)) < fit.held_out
    if len(set(y[~held])) < len(names):
        held[:] = False
    seen = ~held
    weight = (1 / np.bincount(y[seen], minlength=len(names)))[y[seen]][:, None] / len(names)
    target, xs = (code[y[seen]] > 0).astype(np.float32), x[seen]
    W, b = np.zeros((D, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vW, vb = np.zeros_like(W), np.zeros_like(b)
    for _ in range(fit.steps):
        look = W + 0.9 * vW, b + 0.9 * vb
        g = (1 / (1 + np.exp(-(xs @ look[0] + look[1]))) - target) * weight
        vW = 0.9 * vW - fit.rate * (xs.T @ g + fit.decay * look[0]).astype(np.float32)
        vb = 0.9 * vb - fit.rate * g.sum(0).astype(np.float32)
        W, b = W + vW, b + vb
    model.W, model.b = W, b
    test = held if held.any() else seen
    right = np.sign(x[test] @ W + b) == code[y[test]]
    trust = np.stack([(right[y[test] == k].sum(0) + 1) / ((y[test] == k).sum() + 2) for k in range(len(names))])
    model.trust = trust / trust.sum(1, keepdims=True)
    best, _, margin = model.decode(x[test])
    sure = margin[best == y[test]]
    model.doubt = float(np.quantile(sure, fit.doubtful)) if len(sure) else 0.0
    return model


def training_rows(documents: DataFrame, fit: Fit) -> tuple[np.ndarray, list[str]]:
    """Features of the bounded sample, made by the executors; per_language x languages keys are broadcast."""
    ids = documents.select("doc_id", "lang").filter("doc_id is not null and lang is not null").groupBy("doc_id").agg(F.min("lang").alias("label"))
    picked = bounded_sample(ids, ["label"], "doc_id", fit.per_language, fit.seed)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                some = [k for k, t in enumerate(b.column(2).to_pylist()) if lettered(t)]
                if some:
                    b = b.take(pa.array(some))
                    x = features(b.column(2).to_pylist()).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "label", "x"])

    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text")
    got = in_arrow(texts, read, "doc_id long, label string, x binary").toPandas().sort_values(["doc_id", "x"], kind="stable").drop_duplicates("doc_id")
    x = np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(np.float32) if len(got) else np.zeros((0, D), np.float32)
    return x, list(got["label"])


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, language, loss, margin, ambiguous for every row of documents."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in chunks(batch):
                texts = b.column(1).to_pylist()
                some = [k for k, t in enumerate(texts) if lettered(t)] if m.languages else []
                name, loss, margin, unsure = [None] * len(texts), [None] * len(texts), [None] * len(texts), [True] * len(texts)
                if some:
                    for k, i, v, g in zip(some, *m.decode(features([texts[k] for k in some]))):
                        name[k], loss[k], margin[k], unsure[k] = m.languages[i], float(v), float(g), bool(g < m.doubt)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.string()), pa.array(loss, pa.float64()), pa.array(margin, pa.float64()), pa.array(unsure)], names=["doc_id", "language", "loss", "margin", "ambiguous"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(spread(rows), run, "doc_id long, language string, loss double, margin double, ambiguous boolean")


def identified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fit = Fit()
    return identify(documents, train(*training_rows(documents, fit), fit))
