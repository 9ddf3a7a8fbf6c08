"""Unions and distinct values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.text import normalize_text


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables by column name; a column a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, columns: Sequence[str], name: str = "entidade") -> DataFrame:
    """Distinct normalised values over several columns; values that repeat are normalised once."""
    cells = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias(name)).where(f"{name} is not null")
    # Counted rather than made distinct: the optimiser takes a distinct under another one away.
    cells = cells.groupBy(name).agg(F.count(F.lit(1)).alias("vezes")).where("vezes > 0")
    return cells.select(normalize_text(name).alias(name)).where(f"{name} <> ''").distinct()
