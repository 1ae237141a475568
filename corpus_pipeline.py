"""A training corpus from `documents`: quality, exact and near duplicates, mixing, packing.

Each stage reads what its predecessor kept, written as Parquet; all but the last return the
columns of documents. Nulls, empty texts and repeated rows follow the stages' operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import Scratch, table
from vellum.llm.digest_dedup import dedup_documents
from vellum.llm.mixing import mixed_documents
from vellum.llm.near_dedup import near_dedup_documents
from vellum.llm.packing import pack, token_pieces
from vellum.llm.weak_quality import accepted_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the weak-label scorer finds low in quality or toxic (operator 10)."""
    return accepted_documents(docs, table(spark, sf_dir, "labels"), Scratch(spark, "quality"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the smallest doc_id (operator 4)."""
    return dedup_documents(docs, Scratch(spark, "exact"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at 0.8 on five-word shingles keep one (operator 5)."""
    return near_dedup_documents(docs, Scratch(spark, "near"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: sources weigh 5, 2, 1, ... (operator 7)."""
    return mixed_documents(docs, (5, 2, 1), 3.0, 7_041, Scratch(spark, "mix"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of up to 1024: a row per piece, with its ids (operator 6)."""
    pieces = token_pieces(docs, 1024, 2, keep_ids=True, chunks=150_000)  # workers that ran other stages have less room
    return pack(pieces, 1024, Scratch(spark, "pack")).drop("doc")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packing),
]

#: A trained scorer and random rounding aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
