"""A small table with all that real ones throw at an operator."""

import random

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(250_000))
SOLID = "abc7@" * 40_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrnlm") for _ in range(r.randint(2, 8))) for _ in range(n))


def rows():
    body = prose(1, 120)
    return [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 5), (None, body, "en", "a", 9), (None, None, None, None, None),
        (4, LONG, "en", "b", len(LONG)), (5, SOLID, "de", "b", 1), (6, body, "en", "c", 1), (6, body, "en", "c", 1), (7, body, "fr", "c", 1), (8, body + " tail", "de", "d", 1),
        (9, "...", "en", "d", 3), (10, "one", "en", "d", 3), (11, "one two", "de", "d", 3), (12, "ONE, two", "de", "d", 3), (-13, prose(2, 60) + " éß \U0001f600 \x00 end", "es", "a", 1),
    ]


CLASHES = ["h", "sig", "keys", "rep", "gone", "again", "tokens", "shard", "position", "label", "toxic", "score", "threshold", "group_id", "keep", "_rank", "value", "type", "_source", "_below", "tier", "id", "v", "d", "q", "file", "offset", "a", "b", "node", "terms", "term", "n", "start", "end", "seed", "item_id", "language", "w", "name", "low", "before"]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def clashing(df):
    """With columns that operators might use for themselves."""
    return df.select("*", *[F.lit(f"kept {c}").alias(c) for c in CLASHES if c not in df.columns])


def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (6, 1, 0), (7, 1, 1), (8, None, None), (None, 1, 1), (99, 0, 1), (5, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
