"""Change tracking: fingerprints, source registry, differences between snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.operators.budget import delete_by_key, upsert

def row_hash(columns: Sequence[str]) -> Column:
    """60 bits of the MD5 of a row; each cell bears its length and nulls their own mark, so no two rows read alike."""
    cells = [F.coalesce(F.concat(F.lit("s"), F.length(c).cast("string"), F.lit(":"), c), F.lit("n")) for c in (F.col(f"`{c}`").cast("string") for c in columns)]
    return F.conv(F.substring(F.md5(F.concat(*cells)), 1, 15), 16, 10).cast("bigint")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Row count and order-free content sum, of the table or of every source in it."""
    names = list(columns or [c for c in df.columns if c not in by])
    measures = [F.count(F.lit(1)).alias("record_count"),
                F.coalesce(F.sum(row_hash(names).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("soma")]
    return df.groupBy(*by).agg(*measures) if by else df.agg(*measures)


def data_hash(columns: Sequence[str]) -> Column:
    """MD5 over row count, column names and content sum of a fingerprint row."""
    return F.md5(F.concat_ws("_", F.col("record_count").cast("string"), F.lit(",".join(columns)), "soma"))


def source_hashes(df: DataFrame, source: str, columns: Sequence[str]) -> DataFrame:
    return fingerprint(df, columns, [source]).select(source, data_hash(columns).alias("hash"), "record_count")


def check_for_updates(registry: DataFrame, hashes: DataFrame, source: str = "source") -> DataFrame:
    """Enabled sources whose fingerprint differs from the stored one."""
    new = hashes.select(source, F.col("hash").alias("new_hash"), F.col("record_count").alias("new_count"))
    return registry.where("enabled").join(new, source).where(F.col("new_hash") != F.col("last_hash")).select(
        source, F.col("last_hash").alias("old_hash"), "new_hash", F.col("record_count").alias("old_count"), "new_count")


def row_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that appeared or vanished, with how many copies, from one shuffle."""
    columns = old.columns
    both = old.withColumn("_d", F.lit(-1)).unionByName(new.select(*columns).withColumn("_d", F.lit(1)))
    net = both.groupBy(*columns).agg(F.sum("_d").alias("_n")).where("_n <> 0")
    return net.select(F.when(F.col("_n") > 0, "novo").otherwise("removido").alias("mudanca"),
                      F.abs("_n").alias("copias"), *columns)


def register(registry: DataFrame, sources: DataFrame) -> DataFrame:
    """Add sources, replacing those already registered under the same id."""
    return upsert(registry, sources, ["id"], order="last_check")


def unregister(registry: DataFrame, ids: DataFrame) -> DataFrame:
    return delete_by_key(registry, ids, ["id"])


def toggle(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """Flip ``enabled`` of the listed sources."""
    listed = ids.select("id").distinct().withColumn("_t", F.lit(True))
    return registry.join(listed, "id", "left").withColumn(
        "enabled", F.when(F.col("_t"), ~F.col("enabled")).otherwise(F.col("enabled"))).select(*registry.columns)


def monitoring_status(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.count(F.lit(1)).alias("total_sources"), F.count_if("enabled").alias("enabled_sources"),
        F.max("last_check").alias("last_check"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"))
