"""From raw documents to token files: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from portolan.llm import minhash, mixing, quality_rules, token_files, winnow
from portolan.llm.common import read, scratch, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rule and the learned rules."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity 0.8)."""
    return minhash.one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no ten words in a row with a benchmark item."""
    return winnow.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn so that sources, languages and topics meet their target shares of tokens."""
    return mixing.sampled_rows(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, and where each document lies in them."""
    return token_files.token_table(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", good),
    ("near_duplicates", different),
    ("decontamination", unseen),
    ("mixing", mixed),
    ("token_files", tokenized),
]

#: Learning, hashing and encoding are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # What a stage wrote on its way goes once its rows are written.
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", kept=True)
    return docs
