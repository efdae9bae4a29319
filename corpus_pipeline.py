"""A training corpus from raw documents: language ID, exact and near deduplication, mixing, tokens.

Each stage gets what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscan.llm import bpe, exact_dedup, langid, mixing, simhash
from veilscan.llm.common import Scratch, read_table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model tells; those without a letter, or in doubt, go."""
    return langid.accepted(docs, langid.fit(docs, langid.teaches()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id."""
    return exact_dedup.dedup(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more (Jaccard, shingles of five words), the one with the smallest doc_id."""
    return simhash.dedup(docs, size=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(docs)


STAGES = [("langid", identify), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("mix", mix), ("bpe", encode)]

#: Language scores and fingerprints can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
