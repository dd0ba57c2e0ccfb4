"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Stages work on all that the one
before has kept, and meet through Parquet in the shared folder. Null, empty and very long texts, ties, repeated rows and empty tables are
handled as the operators' docstrings say. Ids may be null or come again: a row counts by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orbita.llm import decontaminate as _decontaminate
from orbita.llm import line_dedup as _lines
from orbita.llm import lsh_forest as _forest
from orbita.llm import quality as _quality
from orbita.llm import sentencepiece_codec as _codec
from orbita.llm.queries import tokenizer_path
from orbita.llm.shared import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return _quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that repeat an earlier line: within one edit from 32 characters on, exactly below. Blank lines stay, and every document does, with what is left of its text."""
    return _lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a similarity of 0.8 or more."""
    return _forest.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return _decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text that is left, what they decode to, and digests of both."""
    return _codec.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL can't express the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
