"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns a frame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terravox.llm import decontaminate, packing, quality, simhash, suffix_merge
from terravox.llm.common import read, written
from terravox.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the voters of the labelled documents score 0.7 or more."""
    return quality.accepted(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id."""
    return simhash.deduplicated(docs)


def suffix_array_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a smaller id holds as well."""
    return suffix_merge.deduplicated(docs, length_col="n_chars")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark windows; rows of which they are more than half go."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"), length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in full sequences."""
    return packing.best_fit(docs, tokenizer("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_array_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier, the suffix merge and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
