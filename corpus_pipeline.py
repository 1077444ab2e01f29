"""The corpus pipeline: drop junk, keep one of each group of near copies, mask personal data, pack into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is stored and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import jaccard, packing, pii, quality
from tallyforge.llm.shared import ship, stage, table


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this very input, keeps."""
    ship(spark)
    _, weights = quality.fit(docs)
    return quality.score_documents(docs, weights).where("keep").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by a similarity of 0.8 or more."""
    ship(spark)
    return jaccard.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind."""
    ship(spark)
    return pii.mask_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", drop_junk),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("best-fit packing", pack_sequences),
]
#: SQL has neither the classifier's training nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
