"""The corpus pipeline: filter by quality, drop near-duplicates, decontaminate, redact, mix.

Each stage takes the documents its predecessor kept and is written as Parquet before the next one
reads it.  All stages but the last return the columns of ``documents``; the last adds ``copy``.

Defined cases: an empty table stays one; repeated rows pass the filters alike, until one of them stays
as the only copy; a null text has no words, so it is scored as such, is nobody's copy, contains
nothing, and is mixed as a document without tokens; a null id or source is a value like others; other
columns, whatever their names, are carried along (a ``copy`` of the documents' own stays, and the
number of the copy is in ``copy_1``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mnemora.llm import decontamination, mixing, pii, quality, simhash
from mnemora.llm.common import cleaned, remove, shared_dir, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents above the quality score that tells good labelled documents from bad ones best."""
    return quality.filter_quality(spark, docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near-duplicates."""
    return simhash.drop_duplicates(docs)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than half of every benchmark item."""
    return decontamination.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind in brackets."""
    return pii.redact(spark, docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the balanced rates of their sources say."""
    return mixing.mix_documents(spark, docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", uncontaminated_documents),
    ("pii", redacted_documents),
    ("mixing", mixed_documents),
]

#: SQL can express neither the trained models nor the fingerprints; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's rows are written to the shared folder, and only the last one's stay there."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/mnemora/{uuid.uuid4().hex}-{name}"
        with cleaned(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
