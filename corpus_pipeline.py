"""A training corpus from documents: each stage works on what the one before kept, and the last packs it into windows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from landq.llm import lines, packing, pii, queries, setsketch, toxicity
from landq.llm.common import small_batches, table
from landq.session import shared_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not rejected for toxicity."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without lines that repeat an earlier one."""
    return lines.drop_repeated_lines(docs, least=lines.EVERY)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on shingles of five words."""
    return setsketch.keep_one(docs)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts under pseudonyms."""
    return pii.pseudonymize(docs, queries.KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("toxicity", without_toxic), ("line_dedup", without_repeated_lines), ("near_duplicates", without_near_duplicates),
          ("pseudonyms", with_pseudonyms), ("packing", packed)]
#: Learned weights, token ids and pseudonyms have no form in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet in the shared folder and read again for the next."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
