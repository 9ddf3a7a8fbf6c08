"""Running numbers over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.session import reliable_checkpoint


def number_rows(df: DataFrame, order: Sequence[str], name: str = "numero") -> DataFrame:
    """Number rows 1..n in a unique order.

    Range partitions are numbered side by side and shifted by the sizes of the ones
    before them. The ranges come from a sample, so they are checkpointed: a task
    that runs again sees the same ranges. The offsets are one row per partition.
    """
    ranged = reliable_checkpoint(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("antes"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_i", inside).join(F.broadcast(offsets), "_p").select(
        *df.columns, (F.col("_i") + F.col("antes")).alias(name))


def number_by_first_seen(df: DataFrame, column: str, order: Sequence[str], prefix: str = "CLIENTE_") -> DataFrame:
    """Values of a column with a name in the order they first appear: one row per value."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("_first"))
    keyed = first.select(column, *[F.col(f"_first.{c}").alias(f"_o{i}") for i, c in enumerate(order)])
    numbered = number_rows(keyed, [*[f"_o{i}" for i in range(len(order))], column])
    return numbered.select(column, F.format_string(f"{prefix}%03d", F.col("numero")).alias("anonimo"))


def anonymize(df: DataFrame, column: str = "cliente", order: Sequence[str] = ("data_embarque",)) -> DataFrame:
    """Replace the values of a column by numbered names in first-seen order."""
    names = number_by_first_seen(df, column, order)
    return df.join(names, column, "left").withColumn(column, F.col("anonimo")).select(*df.columns)
