"""Bounded training samples: so many rows of each class, picked by a hash, without a task that reads a whole class."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.common import written

#: Slots of the hash whose sizes are counted; a slot is the most that a class reads beyond its sample.
SLOT_BITS = 10


def smallest_hashes(rows: DataFrame, classes: str, limit: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """At most `limit` rows of each value of `classes`: those with the smallest hash of their keys.

    Rows are counted by class and slot of the hash first; only the slots that the sample reaches into
    are ranked, so the ranking of a class reads limit rows and the rest of one slot, a 1024th of the
    class. The sample does not depend on the layout of the table. Rows with equal keys are ranked in
    any order, so keys should be unique.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(F.lit(seed), *keys)).withColumn("_slot", F.shiftrightunsigned("_hash", 64 - SLOT_BITS))
    counts = hashed.groupBy(F.col(classes).alias("_class"), "_slot").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_class").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    last = (counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).where(F.col("_before") < limit)
            .groupBy("_class").agg(F.max("_slot").alias("_last")))
    near = hashed.join(last, F.col(classes).eqNullSafe(F.col("_class"))).where(F.col("_slot") <= F.col("_last"))
    order = Window.partitionBy("_class").orderBy("_slot", "_hash", *keys)
    return near.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= limit).select(*rows.columns)


def agreed(labels: DataFrame) -> DataFrame:
    """One row per doc_id with its label columns; ids without a number, and ids whose rows disagree or lack a label, are left out."""
    columns = [c for c in labels.columns if c != "doc_id"]
    known = labels.where(F.col("doc_id").isNotNull() & F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)))
    both = known.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns], *[F.max(c).alias(f"_max_{c}") for c in columns])
    return both.where(F.expr(" AND ".join(f"`{c}` = `_max_{c}`" for c in columns))).select("doc_id", *columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, classes: str, per_class: int, seed: int = 0) -> DataFrame:
    """Rows (doc_id, text, label columns), at most per_class of each value of `classes`.

    Labels belong to ids, so an id counts once: of several texts under one id the one with the
    smallest hash is taken. Texts are fetched for the chosen ids only.
    """
    chosen = written(smallest_hashes(agreed(labels), classes, per_class, ["doc_id"], seed).withColumnRenamed("doc_id", "chosen_id"), "sample-ids")
    found = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("chosen_id")).drop("chosen_id")
    columns = [c for c in chosen.columns if c != "chosen_id"]
    # A null text hashes like no other value, so it is a text of its own here.
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), F.struct("text"))).alias("least"), *[F.first(c).alias(c) for c in columns]).select("doc_id", F.col("least.col2.text").alias("text"), *columns)


def row_sample(rows: DataFrame, classes: str, per_class: int, seed: int = 0) -> DataFrame:
    """At most per_class rows of each value of `classes` from a table that holds text and class side by side.

    Rows are told apart by id and text; equal rows count once. Only hashes are ranked, and the texts
    of the chosen rows are kept by their hash, without a join by id alone.
    """
    marked = rows.withColumn("_text", F.xxhash64(F.col("text").cast("string"))).withColumn("_id", F.xxhash64("doc_id"))
    keys = marked.select(classes, "_id", "_text").distinct()
    chosen = written(smallest_hashes(keys, classes, per_class, ["_id", "_text"], seed), "sample-rows")
    same = functools.reduce(operator.and_, [marked[c].eqNullSafe(chosen[c]) for c in chosen.columns])
    return marked.join(chosen, same, "left_semi").dropDuplicates(chosen.columns).select(*rows.columns)
