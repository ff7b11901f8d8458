"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes what its predecessor kept, written as Parquet and read again, and returns documents with the same
columns; the last returns pieces of packed sequences. SQL cannot express learned languages, register sketches or a
tokenizer, so ``ORACLE_SQL`` is None and tests/llm compares the stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import decontaminate, language, near_dedup, packing, repeat_dedup
from basketry.llm.scratch import new_folder, read_table, steps


#: Jaccard similarity of 5-word shingles from which documents are near copies; operator 2's own threshold is higher.
NEAR = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in a language the corpus names; null texts, texts without a letter and texts that score below all
    others of their size go. Without any named language all texts with a letter stay."""
    return language.accepted(docs, language.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id; equal rows are one."""
    return near_dedup.one_of_each(docs, NEAR)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that repeat; a text that loses nothing stays byte for byte."""
    return repeat_dedup.without_repeats(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences of all that is left."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage writes on its way goes when its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        with steps(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
