"""Corpus cleaning as five stages over the documents table.

Each stage reads what the one before kept.  Nulls, empty texts and repeated rows
are treated as the operators in ``tidewell.llm`` say; rows without a doc_id stay
in until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontam, neardup, suffix_dedup, toxicity
from tidewell.llm.lineage import drop_stored, stored
from tidewell.llm.queries import bpe_digests


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model rejects."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return neardup.keep_one(docs, neardup.near_duplicates(docs))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that also start earlier in the corpus; texts of which nothing is left go."""
    return suffix_dedup.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, up to small edits."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the byte-level BPE ids of every document that is left, and of the decoded text."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", neardup_stage),
    ("suffix_array_dedup", repeats_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", encode_stage),
]
#: Models, samples and suffix arrays can't be stated in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage keeps is written before the next one reads it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop_stored(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
