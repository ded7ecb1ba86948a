"""Corpus pipeline: quality classifier, exact dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept,
and returns a DataFrame; run() writes each as Parquet in the shared folder and reads it
again. All but the last return the columns of documents.

Nulls, empties and ties: a null text counts as empty in every stage. Empty texts are scored
by the classifier's bias, are copies of each other, hold no personal data and pack to their
end token. Rows without an id take part as any other; of equal texts the row of the largest
id stays (one of repeated rows), of near copies that of the smallest. An empty table passes
through all stages, other columns are carried up to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waymark.deploy import ship
from waymark.llm import exact_dedup, near_dedup, packing, pii, quality
from waymark.llm._common import materialise, read_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    ship(spark)
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    ship(spark)
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest doc_id."""
    ship(spark)
    return near_dedup.keep_one(docs, threshold=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in text, n_chars to match."""
    ship(spark)
    return pii.mask_personal(docs, pii.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: The classifier's and the field's learned weights can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
