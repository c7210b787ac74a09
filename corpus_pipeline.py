"""The training-data pipeline over ``documents``.

STAGES run in order; each takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next stage's ``docs``.  All
but the last return the columns of ``documents``.

Defined cases: null or empty texts fall to the quality rules; rows that repeat
an id with different texts are documents of their own, and of rows that repeat
id and text the near-duplicate stage keeps one; an empty table stays empty;
further columns are carried along up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillmatch.llm.common import shared_folder, table
from quillmatch.llm.decontaminate import uncontaminated
from quillmatch.llm.minhash import one_of_each
from quillmatch.llm.packing import pack
from quillmatch.llm.quality import passing
from quillmatch.llm.queries import vocabulary
from quillmatch.llm.substring import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8 or more)."""
    return one_of_each(docs, shingle=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 35-word windows that start twice."""
    return without_repeats(docs, size=35)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items (five words, 0.8 or more)."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack(docs, vocabulary(), capacity=4096, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokenizing and packing have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
