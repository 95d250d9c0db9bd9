"""The corpus pipeline: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder
and rereads it as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, near_duplicates, packing, quality, secrets
from millrace.llm.common import materialize
from millrace.llm.tokens import public_vocabulary
from millrace.session import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rule ensemble does not reject; it learns from the labels of sf_dir.

    Null text counts as empty; rows that repeat are judged alike; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that shingle links connect, the one with the smallest id.

    Rows without doc_id or without words stay, as do all rows that repeat the id which stays.
    """
    return near_duplicates.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars follows. Null text stays null."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    A null source is a source of its own; rows that repeat id, source and size share their copies evenly.
    """
    return mixing.resample(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; null text is the end id alone."""
    return packing.pack(docs, public_vocabulary(), end_id=2)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicate_groups", near_duplicate_groups),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier's weights, the random offset and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
