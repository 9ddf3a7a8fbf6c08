"""Queries of the operators that judge or filter documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from portolan.llm import minhash, mixing, quality_rules, token_files, winnow
from portolan.llm.common import read
from portolan.llm.queries import query


@query("op1_quality_rules")
def quality_rules_query(spark, d):
    judged = quality_rules.score_table(read(spark, d, "documents"), read(spark, d, "labels"))
    return judged.select("row.doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


@query("op7_minhash_dedup")
def minhash_dedup_query(spark, d):
    found = minhash.near_duplicates(read(spark, d, "documents").select("doc_id", "text"), size=2, similarity=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_winnowing")
def winnowing_query(spark, d):
    found = winnow.contamination(read(spark, d, "documents"), read(spark, d, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op6_mixing")
def mixing_query(spark, d):
    drawn = mixing.calibrated(read(spark, d, "documents"))
    return drawn.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "tokens", "weight", "probability", "sampled")


@query("op10_token_files")
def token_files_query(spark, d):
    return token_files.token_table(read(spark, d, "documents").select("doc_id", "text"))
