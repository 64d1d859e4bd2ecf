"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

1. toxicity: documents scored 0.5 or more go.
2. near_duplicates: of each group of near duplicates (5 words, 0.8) the one with the smallest id stays.
3. secrets: what the forest takes for a secret is masked in the text.
4. mixing: a document stands as often as its source's share asks, or not at all.
5. packing: the documents' ids in sequences of 2,048."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import mixing, ngram_join, packing, secrets, toxicity
from tesserae.llm.common import shelve, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_duplicates", ngram_join.stage),
    ("secrets", secrets.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Trained scores, a forest and a tokenizer are not SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; each stage is written to the shared folder, and the one before
    it deleted."""
    docs, drop = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, done = shelve(stage(spark, docs, sf_dir))
        if drop is not None:
            drop()
        drop = done
    return STAGES[-1][1](spark, docs, sf_dir)
