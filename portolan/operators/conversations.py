"""Conversation tables: rows (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TITLE_LENGTH = 50


def titles(messages: DataFrame) -> DataFrame:
    """Title from the first message when the user wrote it, cut with dots; null otherwise."""
    first = messages.groupBy("conv_id").agg(F.min_by(F.struct("role", "text"), "turn").alias("m"))
    text = F.col("m.text")
    cut = F.when(F.length(text) > TITLE_LENGTH, F.concat(F.substring(text, 1, TITLE_LENGTH), F.lit("..."))).otherwise(text)
    return first.select("conv_id", F.when(F.col("m.role") == "user", cut).alias("titulo"))


def ordered_messages(messages: DataFrame, conv_id: int | None = None) -> DataFrame:
    rows = messages if conv_id is None else messages.where(F.col("conv_id") == conv_id)
    return rows.orderBy("conv_id", "turn")


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Add messages (conv_id, role, text, ordem) after the last turn of their conversation."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("ultimo"))
    order = Window.partitionBy("conv_id").orderBy("ordem")
    added = new.join(last, "conv_id", "left").select(
        "conv_id", (F.coalesce("ultimo", F.lit(-1)) + F.row_number().over(order)).cast("bigint").alias("turn"), "role", "text")
    return messages.select("conv_id", "turn", "role", "text").unionByName(added)


def last_messages(messages: DataFrame, n: int = 5) -> DataFrame:
    """Last n messages of every conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")


def list_conversations(messages: DataFrame, limit: int = 50) -> DataFrame:
    """Newest conversations of every user, with title and message count.

    Expects ``user_id`` and ``timestamp`` besides the message columns.
    """
    heads = messages.groupBy("user_id", "conv_id").agg(
        F.max("timestamp").alias("updated_at"), F.count(F.lit(1)).alias("message_count"),
        F.min_by(F.struct("role", "text"), "turn").alias("m"))
    order = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "conv_id")
    text = F.col("m.text")
    cut = F.when(F.length(text) > TITLE_LENGTH, F.concat(F.substring(text, 1, TITLE_LENGTH), F.lit("..."))).otherwise(text)
    return heads.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).select(
        "user_id", "conv_id", F.when(F.col("m.role") == "user", cut).alias("titulo"), "updated_at", "message_count")


def statistics(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count_distinct("conv_id").alias("total_conversations"), F.count(F.lit(1)).alias("total_messages"))
