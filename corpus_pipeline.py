"""The pipeline over documents: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrollmill.llm import bpe, exact_dedup, langid, minhash_dedup, mixing
from scrollmill.llm.common import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told, as they are null or have no letter, go. The language found replaces `lang`."""
    return langid.keep_known(docs, langid.learn(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, and of equal rows one; empty and null texts are equal."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least doc_id; null ids come last."""
    return minhash_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources say; null is a source of its own."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the token ids of each document of the mix and of the text that they decode to; a null text has none."""
    return bpe.round_trip(docs, bpe.default_vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents` of sf_dir, each over the table that the one before has written. An empty table gives an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs


#: The language model and the tokens are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None
