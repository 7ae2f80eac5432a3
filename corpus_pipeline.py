"""The corpus pipeline: toxicity, exact copies, near copies, benchmark leaks, packing.

Each stage is one operator of ``ticketlens.llm``, works on all rows that the stage before
kept, and is written as Parquet and read again. All but the last keep the columns of
``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketlens.llm import decontamination, exact_dedup, ngram_join, packing, toxicity
from ticketlens.llm.common import prepare, read_table
from ticketlens.llm.registry import word_vocabulary
from ticketlens.session import stage


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    prepare(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle similarity links."""
    prepare(spark)
    return ngram_join.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    prepare(spark)
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, packed into sequences."""
    prepare(spark)
    return packing.best_fit_packing(docs, word_vocabulary())


STAGES = [
    ("toxicity", clean_language),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed_sequences),
]

#: SQL expresses neither the classifier nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what each keeps is stored in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, apply) in enumerate(STAGES, 1):
        docs = apply(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stage(docs, name)
    return docs
