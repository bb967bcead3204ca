"""Corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Null texts have no language and leave at the first stage; an empty table passes through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbloom.llm import jaccard_join, language_id, packing, suffix_array_dedup
from orbloom.llm._arrow import dropped, saved

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
REPEAT_BYTES = 200
LEAST_GAIN = 0.2  # of the way from a chance score to certainty


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or a score near chance (junk, languages not learned)."""
    return language_id.keep_identified(docs, LEAST_GAIN)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest doc_id, of each group of near copies (word 5-grams, similarity 0.8).

    Rows with an empty set all stay; rows of one doc_id and different texts are told apart.
    """
    return jaccard_join.keep_one(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of 200 bytes or more that stands anywhere else; documents left blank go.

    Repeated rows that are still there cut each other; null texts stay as they are.
    """
    return suffix_array_dedup.strip_repeats(docs, REPEAT_BYTES)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents that are left into sequences of 2048 tokens; one row per piece, a null text being empty."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("suffix_array_dedup", suffix_stage),
    ("best_fit_packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
