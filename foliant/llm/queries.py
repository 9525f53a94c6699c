"""Queries of this subpackage, each over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .ann import embedding_neighbours
from .decontam import leaked_benchmark
from .langid import identified_documents
from .mixing import MIXED_SQL, mixed_documents
from .neardup import near_duplicate_documents
from .pii import private_documents
from .sharding import sharded_documents
from .tokencount import counted_documents
from .toxicity import toxic_documents
from .warc import PAGES_SQL, distinct_pages

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_pii_bootstrap": private_documents,
    "op2_ann_collision_counting": embedding_neighbours,
    "op3_token_counts": counted_documents,
    "op4_warc_index": distinct_pages,
    "op5_language_id": identified_documents,
    "op6_toxicity": toxic_documents,
    "op7_sharding": sharded_documents,
    "op8_mixing": mixed_documents,
    "op9_decontamination": leaked_benchmark,
    "op10_minhash_lsh_forest": near_duplicate_documents,
}

ORACLES: dict[str, str] = {
    "op4_warc_index": PAGES_SQL,
    "op8_mixing": MIXED_SQL,
}
