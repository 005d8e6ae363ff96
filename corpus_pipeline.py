"""The corpus pipeline: quality classifier, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept. All but the last return the columns of `documents`.

Null and empty texts are scored as empty and then fail the quality rules. Rows
that repeat an id and a text are one document, and of each class of near
duplicates the least id stays, ids before nulls. An empty table gives no rows.
Extra columns, of any name, stay until the packing, which ignores them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sableframe.llm import near_duplicates, packing, quality_classifier, quality_rules
from sableframe.llm.common import checkpoint_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the nearest-neighbour classifier rejects; it learns from the labelled rows of `docs`."""
    return quality_classifier.accepted(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what any quality rule rejects."""
    return quality_rules.passing(docs)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    return near_duplicates.without_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document into training sequences."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("rules", rules), ("near_duplicates", near_duplicates_out), ("packing", pack)]

#: Learned and packed stages have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
