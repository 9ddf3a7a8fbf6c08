"""Goal tables: upserts, budget against actual, status bands."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions.numbers import percent
from portolan.operators.aggregates import OPERATION_TYPES, performance, sum_by

# Margin of a year without a goal.
DEFAULT_MARGIN = 0.15


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: str = "updated_at") -> DataFrame:
    """Union by key; the row with the latest ``order`` wins, one row per key.

    A maximum over a struct combines before the shuffle, so a key written many
    times never travels as many rows.
    """
    rest = [c for c in current.columns if c not in keys and c != order]
    row = F.struct(order, *rest)
    latest = current.unionByName(changes.select(*current.columns)).groupBy(*keys).agg(F.max(row).alias("r"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in current.columns])


def delete_by_key(current: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def with_default_goals(goals: DataFrame, years: DataFrame) -> DataFrame:
    """Annual goals for every year asked for; a year without one gets zeros and the default margin."""
    return years.select("ano").distinct().join(goals, "ano", "left").select(
        "ano", F.coalesce("receita_total", F.lit(0.0)).alias("receita_total"),
        F.coalesce("containers_total", F.lit(0)).alias("containers_total"),
        F.coalesce("novos_clientes", F.lit(0)).alias("novos_clientes"),
        F.coalesce("margem_lucro", F.lit(DEFAULT_MARGIN)).alias("margem_lucro"),
    )


def default_operation_goals(actual: DataFrame) -> DataFrame:
    """Zero goals beside the actual total of each of the three operations."""
    cells = F.array(*[F.lit(o) for o in OPERATION_TYPES])
    base = actual.sparkSession.range(1).select(F.explode(cells).alias("tipo_operacao"))
    return base.join(sum_by(actual, "tipo_operacao"), "tipo_operacao", "left").select(
        "tipo_operacao", F.lit(0).cast("bigint").alias("meta_containers"), F.lit(0.0).alias("meta_receita"),
        F.coalesce("total", F.lit(0.0)).alias("realizado"))


def budget_vs_actual(goals: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Goals with their actuals and the percentage reached (0 when the goal is 0)."""
    joined = goals.join(actual, list(keys), "left").withColumn("realizado", F.coalesce("realizado", F.lit(0.0)))
    return joined.select(*keys, "meta", "realizado", percent(F.col("realizado"), F.col("meta")).alias("percentual"))


def annual_status(p: Column | str) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return F.when(c >= 100, "atingida").when(c >= 80, "boa").when(c >= 50, "moderada").otherwise("baixa")


def monthly_status(p: Column | str) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return F.when(c >= 100, "atingida").when(c >= 80, "boa").otherwise("em_andamento")


def budget_as_of(df: DataFrame, annual: DataFrame, months: DataFrame, as_of: datetime.date) -> DataFrame:
    """Year and month of ``as_of`` against their goals, with status."""
    real = performance(df, as_of).where(F.col("escopo").isin("anual", "mensal_atual")).select("escopo", "containers")
    goals = annual.where(F.col("ano") == as_of.year).select(
        F.lit("anual").alias("escopo"), F.col("containers_total").cast("double").alias("meta")
    ).unionByName(months.where(F.col("mes_chave") == f"{as_of:%Y-%m}").select(
        F.lit("mensal_atual").alias("escopo"), F.col("containers").cast("double").alias("meta")))
    compared = budget_vs_actual(goals, real.withColumnRenamed("containers", "realizado"), ["escopo"])
    return compared.withColumn("status", F.when(F.col("escopo") == "anual", annual_status("percentual"))
                               .otherwise(monthly_status("percentual")))
