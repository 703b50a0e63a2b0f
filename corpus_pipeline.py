"""A corpus pipeline of five stages: language, exact copies, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. What a
stage drops is gone for the next. Between stages the documents are written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from curator.llm.bpe import encode_and_decode
from curator.llm.decontaminate import keep_clean
from curator.llm.exact_dedup import keep_first
from curator.llm.language import keep_known
from curator.llm.simhash import keep_one
from curator.scratch import materialize

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the table's own labels teach; texts without letters go."""
    return keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts that are equal but for white space."""
    return keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of their five-word shingles.

    Candidates are SimHash fingerprints within 10 bits, found by the pivot table; similar texts further apart are searched exactly.
    """
    return keep_one(docs, size=5, most=10, least=0.8)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``benchmark``."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with their count and digests."""
    return encode_and_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language", language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontaminate", benchmark_passages),
    ("bpe", tokens),
]

#: SQL cannot express the language, near-copy and token stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
