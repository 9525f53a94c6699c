"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its seed and doc_id. The tokens of each source are summed by the leading bits of that
hash; running sums show in which bucket each budget ends, and only those buckets are split by the next bits, until a bucket
holds one hash. A document is kept for a budget if its hash is below the threshold, so no rows are sorted and a smaller
budget's documents are part of every larger one's. The histograms stay DataFrames; the driver sees only how many buckets are still
open.

A budget is share x all tokens x the source's weight / all weights, rounded down; a source with fewer tokens than that is
kept whole (nothing is repeated). Weights default to 1 for every source; of given weights, those of sources not named are
`other` (0). Thresholds keep the longest run of least hashes whose tokens
don't exceed the budget.

Defined results: tokens are what stands between white space; null and empty texts have none and are kept if their hash lies
before the first document that breaks the budget. A null source is a source of its own. A null doc_id hashes like the empty string. Repeated rows and rows of one
doc_id share a hash and go together. A weight of 0 keeps no tokens; weights below 0 are an error. Other columns pass
through `mix` as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, table

SHARES = (0.15, 0.3, 0.6)
WEIGHTS, OTHER = {"src0": 2.0, "src1": 0.5, "src2": 0.25}, 1.0  # of the registered query
SEED = "mix"
BITS, STEP = 60, 12


def hash60(doc_id: Column, seed: str = SEED) -> Column:
    """60 bits of MD5, which SQL engines agree on."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def token_count(text: Column) -> Column:
    """How many strings stand between white space."""
    inner = F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+"))
    return F.coalesce(inner.cast("long"), F.lit(0).cast("long"))


def sized(documents: DataFrame, seed: str) -> DataFrame:
    """source, h, tokens of every document."""
    return documents.select(F.col("source").cast("string").alias("source"), hash60(F.col("doc_id"), seed).alias("h"), token_count(F.col("text")).alias("tokens"))


def thresholds(rows: DataFrame, scratch: Scratch, shares: tuple[float, ...], weights: dict[str, float] | None, other: float = 0.0) -> DataFrame:
    """(source, tier, below): documents of a source with h < below belong to the tier; tiers count from 0."""
    if weights and min(*weights.values(), other) < 0:
        raise ValueError("weights must not be negative")
    total = F.col("all_tokens")
    w = F.lit(1.0)
    sources = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    if weights is not None:
        given = rows.sparkSession.createDataFrame(list(weights.items()), "name string, w double")
        sources = sources.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
        w = F.coalesce(F.col("w"), F.lit(float(other)))
    everything = Window.partitionBy()
    sources = sources.withColumn("all_tokens", F.sum("tokens").over(everything)).withColumn("w", w)
    sources = sources.withColumn("share", F.when(F.sum("w").over(everything) > 0, F.col("w") / F.sum("w").over(everything)).otherwise(0.0))
    tiers = F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.floor(F.lit(float(s)) * total * F.col("share")).alias("budget")) for k, s in enumerate(shares)]))
    # state: the bucket [low, low + 2**open_bits) of a source's tier in which its budget ends, and the tokens before it
    state = sources.select("source", tiers.alias("t")).select("source", "t.tier", "t.budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"))
    done = None
    for bits in range(BITS - STEP, -1, -STEP):
        width = 1 << bits
        opened = state.select(F.col("source").alias("s"), "low").distinct()
        above = 1 << (bits + STEP)
        top = F.shiftright("h", bits + STEP) * F.lit(above)
        # at first every row is inside; later the few open buckets, whose written table Spark knows the size of
        inside = rows.withColumn("low", F.lit(0).cast("long")) if done is None else rows.join(opened, F.col("source").eqNullSafe(F.col("s")) & (top == F.col("low")))
        bucket = F.shiftright("h", bits) * F.lit(width)
        histogram = scratch.save(inside.groupBy("source", "low", bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.min("h").alias("first"), F.max("h").alias("last")), "histogram")
        running = Window.partitionBy("source", "low").orderBy("bucket")
        summed = histogram.withColumn("upto", F.sum("tokens").over(running)).withColumnsRenamed({"source": "s", "low": "l"})
        ends = state.join(summed, F.col("source").eqNullSafe(F.col("s")) & (F.col("low") == F.col("l")) & (F.col("before") + F.col("upto") > F.col("budget")), "left")
        first = ends.groupBy("source", "tier", "budget", "low", "before").agg(F.min_by(F.struct("bucket", "upto", "tokens", "first", "last"), "bucket").alias("e"))
        first = scratch.save(first, "ends")
        # no bucket breaks the budget: everything up to the end of the open range is kept
        whole = first.filter("e is null").select("source", "tier", (F.col("low") + F.lit(above)).alias("below"))
        single = first.filter("e.first = e.last").select("source", "tier", F.col("e.first").alias("below"))
        done = whole.union(single) if done is None else done.union(whole).union(single)
        state = first.filter("e.first < e.last").select("source", "tier", "budget", F.col("e.bucket").alias("low"), (F.col("before") + F.col("e.upto") - F.col("e.tokens")).alias("before"))
        if not state.limit(1).count():
            break
    return scratch.save(done, "thresholds")


def tiers(documents: DataFrame, shares: tuple[float, ...] = SHARES, weights: dict[str, float] | None = None, seed: str = SEED, other: float = 0.0) -> DataFrame:
    """The thresholds of every source, a row each: `__source` and `__below`, an ascending array with one hash for each share."""
    scratch = Scratch(documents.sparkSession)
    rows = scratch.save(sized(documents, seed), "sized")
    t = thresholds(rows, scratch, shares, weights, other)
    scratch.remove(rows)
    below = F.transform(F.sort_array(F.collect_list(F.struct("tier", "below"))), lambda x: x["below"])
    return scratch.save(t.groupBy(F.col("source").alias("__source")).agg(below.alias("__below")), "tiers")


def mix(documents: DataFrame, share: float = SHARES[-1], weights: dict[str, float] | None = None, seed: str = SEED, other: float = 0.0) -> DataFrame:
    """The rows of documents that the budget keeps, all columns as they came."""
    t = tiers(documents, (share,), weights, seed, other)
    kept = documents.join(t, F.col("source").eqNullSafe(F.col("__source")) & (hash60(F.col("doc_id"), seed) < F.col("__below")[0]))
    return kept.select(*[documents[f"`{c}`"] for c in documents.columns])


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and the least tier (share SHARES[tier] of all tokens) of every document that any budget keeps,
    the sources in WEIGHTS having these weights and all others OTHER."""
    documents = table(spark, sf_dir, "documents")
    t = tiers(documents, weights=WEIGHTS, other=OTHER)
    h = hash60(F.col("doc_id"))
    ids = documents.select("doc_id", "source")
    tier = F.size(F.filter("__below", lambda b: b <= F.col("h")))
    found = ids.withColumn("h", h).join(t, F.col("source").eqNullSafe(F.col("__source"))).withColumn("tier", tier)
    return found.filter(F.col("tier") < len(SHARES)).select("doc_id", "source", "tier")


MIXED_SQL = """
WITH sized AS (
  SELECT doc_id, source, ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+')) AS tokens
  FROM documents
), run AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sized
), weight AS (
  SELECT source, CAST(CASE source WHEN 'src0' THEN 2 WHEN 'src1' THEN 0.5 WHEN 'src2' THEN 0.25 ELSE 1 END AS DOUBLE) AS w FROM (SELECT DISTINCT source FROM sized)
), budget AS (
  SELECT source, w / (SELECT sum(w) FROM weight) AS share, (SELECT sum(tokens) FROM sized) AS n FROM weight
)
SELECT r.doc_id, r.source,
       CAST(CASE WHEN upto <= floor(0.15::DOUBLE * n * share) THEN 0 WHEN upto <= floor(0.3::DOUBLE * n * share) THEN 1 ELSE 2 END AS INTEGER) AS tier
FROM run r JOIN budget b ON r.source IS NOT DISTINCT FROM b.source
WHERE upto <= floor(0.6::DOUBLE * n * share)
"""
