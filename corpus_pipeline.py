"""Corpus pipeline: language ID, exact dedup, near-dedup, mixing to weights, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's documents.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, language_id, mixing, near_copies, packing
from textloom.llm.common import saved
from textloom.llm.queries import tokenizer_path

# A document in one of four languages scores 0.88 on average; only texts that no language claims fall below this.
MIN_SCORE = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no language claims, go."""
    model = language_id.fit(docs)
    found = language_id.predict(docs, model, keep=tuple(docs.columns))
    rejected = (F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < MIN_SCORE)
    return found.where(~rejected).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash components at two bits, joined with links of five-word shingle sets at similarity 0.8 or more."""
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight says; some sources' more than once, others' in part."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# A trained network and fingerprints have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
