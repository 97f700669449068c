"""Corpus pipeline: documents in, packed training sequences out.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over the rows its predecessor kept; ``run`` writes a
stage's rows as Parquet to the shared folder and hands them, read again, to the next. All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sessionmill.llm import decontaminate, exact, jaccard, langid, packing
from sessionmill.llm.frames import documents, store
from sessionmill.llm.queries import id_hash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a recognised language; the network learns from the labelled rows of the input."""
    return langid.reject_unknown(docs, langid.train(docs, id_hash(4) != 2))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each text."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return jaccard.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that leak no benchmark item."""
    return decontaminate.drop_leaked(docs, documents(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("row")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]

# Models, MinHash and bin choices are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
