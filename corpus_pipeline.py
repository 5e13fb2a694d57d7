"""The corpus pipeline: toxicity, exact duplicates, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. The last returns doc_id, n_tokens, ids and two digests of each row it is given.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braid.llm import bpe, exact_dedup, mixing, near_simhash, toxicity
from braid.llm.common import documents, dropped, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("simhash", near_simhash.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]
#: The model and the similarity of texts have no SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
