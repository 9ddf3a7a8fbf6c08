"""Audit-log lines: ``time - level - ACCESS: user - action - resource``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Messages of an allowed and a denied access.
PATTERN = r"^(\S+ \S+) - (\w+) - (ACCESS|ACCESS_DENIED): (.*?) - (.*?)(?: - (.*))?$"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.readStream.text(path))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Access lines as columns; other lines are left out."""
    def part(i: int):
        return F.regexp_extract(column, PATTERN, i)

    return lines.where(F.col(column).rlike(PATTERN)).select(
        part(1).try_cast("timestamp").alias("momento"), part(2).alias("nivel"), part(4).alias("usuario"),
        part(5).alias("acao"), part(6).alias("recurso"), (part(3) == "ACCESS").alias("permitido"))


def access_log(lines: DataFrame, user: str | None = None, days: int = 7, as_of=None, limit: int = 100) -> DataFrame:
    """Last accesses, of one user or of all, within some days before ``as_of`` (the newest line when not given)."""
    newest = lines.agg(F.max("momento")).scalar() if as_of is None else F.lit(as_of).cast("timestamp")
    rows = lines.where(F.col("momento") >= newest - F.make_dt_interval(F.lit(days)))
    rows = rows.where(F.col("usuario") == user) if user else rows
    return rows.orderBy(F.desc("momento"), "usuario", "acao", "recurso").limit(limit)


def access_summary(lines: DataFrame) -> DataFrame:
    """Lines and accesses in total."""
    return lines.agg(F.count(F.lit(1)).alias("total_accesses"), F.count_if("permitido").alias("recent_accesses"))
