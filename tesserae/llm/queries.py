"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import media, mixing, ngram_join, packing, secrets, suffix_dedup, token_counts, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": ngram_join.op1,
    "op2_mixing": mixing.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_progressive_jpeg": media.op4,
    "op5_token_counts": token_counts.op5,
    "op6_toxicity": toxicity.op6,
    "op7_warc": warc.op7,
    "op8_secrets": secrets.op8,
    "op9_packing": packing.op9,
    "op10_topk": topk.op10,
}

SQL: dict[str, str] = {"op2_mixing": mixing.SQL, "op7_warc": warc.SQL, "op10_topk": topk.SQL}
