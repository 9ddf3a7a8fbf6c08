"""Writers: processed sets, snapshots and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_processed(df: DataFrame, path: str, schema: str, period: str = "ano_mes", batch: str | None = None) -> None:
    """Add to the processed set, one folder per schema and month, so readers prune by both.

    With a batch id its rows lie in folders of their own (column ``lote``), and the batch written again
    takes the place of its former rows in the months it has. Without one, rows are appended.
    Rows of a month are rebalanced, which splits a large month over several files
    and keeps small ones from being scattered.
    """
    rows = df.withColumn("schema", F.lit(schema)).hint("rebalance", period)
    if batch is None:
        rows.write.partitionBy("schema", period).mode("append").parquet(path)
    else:
        rows.withColumn("lote", F.lit(batch)).write.partitionBy("schema", period, "lote").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_snapshot(df: DataFrame, path: str, snapshot: str) -> None:
    """A dated copy; writing the same date again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/snapshot={snapshot}")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
