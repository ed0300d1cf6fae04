"""The training-data operators as registered queries over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann, collocations, conversation_trie, line_dedup, packing, quality_rules, sentencepiece_scan, simhash, substring_dedup,
    suffix_dedup, token_counts, toxicity, url_filter,
)
from .common import table

#: Host and path rules of the URL query.
URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
    ("net/fr/", "block"),
]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("rk")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3).drop("rk", "root")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"), short_lines=True).drop("rk")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), k=35).drop("rk")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cap=2048, end_id=0)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    tokens = sentencepiece_scan.decode(sentencepiece_scan.encode(table(spark, sf_dir, "documents"), model), model)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32",
        (F.col("decoded") == F.replace("text", F.lit(sentencepiece_scan.SPACE), F.lit(" "))).alias("round_trip"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=400).drop("spans", "kept")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = conversation_trie.rebuilt_trie(table(spark, sf_dir, "conversations"), group=100, heads=6)
    return trie.drop("node", "parent")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, absorb=50, top=2000)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_toxicity, op3_simhash, op4_nearest, op5_url_filter, op6_token_counts, op7_line_dedup,
        op8_substring_dedup, op9_packing, op10_sentencepiece, op11_suffix_dedup,
        op12_conversation_trie, op13_collocations,
    )
}
ORACLES: dict[str, str] = {
    "op12_conversation_trie": conversation_trie.ORACLE, "op13_collocations": collocations.ORACLE,
}
