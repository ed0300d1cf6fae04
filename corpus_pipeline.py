"""From documents to packed training sequences.

Quality rules, line deduplication, SimHash near-deduplication, substring deduplication and packing, each
over all that the stage before kept. Between stages the documents are written as Parquet to the
shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import line_dedup, packing, quality_rules, simhash, substring_dedup
from ledgerline.llm.common import shared_table, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where the documents have it, follows their text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and boilerplate lines of the others."""
    return _counted(quality_rules.keep_good(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, or nearly repeat, an earlier line go."""
    return _counted(line_dedup.remove_lines(docs, short_lines=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that start anywhere else go."""
    return _counted(substring_dedup.without_repeats(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cap=2048, end_id=0)


STAGES = [
    ("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings), ("best-fit packing", packed),
]

#: SQL has neither the hashes nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if n == 0 else shared_table(docs), sf_dir)
    return docs
