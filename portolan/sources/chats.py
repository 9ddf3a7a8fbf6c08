"""Conversation files: one JSON document per chat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id STRING, created_at STRING, messages ARRAY<STRUCT<role: STRING, content: STRING>>"


def read_chats(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Messages (conv_id, turn, role, text) of every chat: a file each, or a line each. A task holds one chat."""
    chats = spark.read.schema(SCHEMA).option("multiLine", not one_per_line).json(path)
    return chats.select("id", F.col("created_at").try_cast("timestamp").alias("created_at"), F.posexplode("messages").alias("turn", "m")).select(
        F.col("id").alias("conv_id"), "created_at", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"),
        F.col("m.content").alias("text"))


def as_chats(messages: DataFrame) -> DataFrame:
    """Messages folded into one nested row per chat, ready to be written as JSON."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return messages.groupBy(F.col("conv_id").cast("string").alias("id")).agg(ordered.alias("m")).select(
        "id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
