"""Top-k and rankings; ties always break on the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.shape import inline_rows
from portolan.operators.aggregates import container_total, sum0


def top_n(df: DataFrame, column: str, n: int = 10, by: str | None = None) -> DataFrame:
    """Most frequent values, or those with the largest sum of another column."""
    measure = sum0(by).alias("valor") if by else F.count(F.lit(1)).cast("double").alias("valor")
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(measure)
        .orderBy(F.desc("valor"), column).limit(n)
    )


def top_clients(df: DataFrame, limit: int = 10, year: int | None = None) -> DataFrame:
    rows = df.where(F.col("ano") == year) if year else df
    return (
        rows.where(F.col("cliente").isNotNull()).groupBy("cliente")
        .agg(sum0("qtd_container").cast("bigint").alias("total_containers"), F.count("ano_mes").alias("num_operacoes"))
        .orderBy(F.desc("total_containers"), "cliente").limit(limit)
    )


def ranking_with_share(df: DataFrame, field: str, n: int = 5) -> DataFrame:
    """Top n by the container cascade, with their joint share of the whole."""
    totals = df.where(F.col(field).isNotNull()).groupBy(field).agg(container_total(df.columns).alias("total"))
    whole = df.agg(container_total(df.columns)).scalar()
    top = totals.orderBy(F.desc("total"), field).limit(n)
    over_top = Window.orderBy(F.desc("total"), field)
    return top.select(
        F.row_number().over(over_top).alias("posicao"), field, "total",
        F.when(whole > 0, F.sum("total").over(Window.partitionBy()) * 100.0 / whole).alias("percentual_top"),
        whole.alias("total_geral"),
    )


def carriers_at_port(df: DataFrame, n: int = 5) -> DataFrame:
    """Carriers by containers, for rows already limited to a port and a year."""
    return (
        df.where(F.col("armador").isNotNull()).groupBy("armador").agg(sum0("qtd_container").alias("total_containers"))
        .orderBy(F.desc("total_containers"), "armador").limit(n)
    )


def arg_max(df: DataFrame, key: str, value: str = "qtd_container") -> DataFrame:
    """The key with the largest total."""
    return top_n(df, key, 1, by=value)


def top_company(df: DataFrame, columns: Sequence[str], n: int = 1, value: str = "qtd_container") -> DataFrame:
    """Companies over several client columns: a company named in two columns of a
    row counts twice; blank names and totals not above 0 per column are left out.
    """
    names = inline_rows(("coluna", "nome", "v"), [(F.lit(c), F.col(c), F.col(value)) for c in columns])
    per_column = (
        df.select(names).where("nome is not null")
        .groupBy("coluna", "nome").agg(sum0("v").alias("v")).where("v > 0 and trim(nome) <> ''")
    )
    return (
        per_column.groupBy(F.trim("nome").alias("empresa")).agg(F.sum("v").alias("total"))
        .orderBy(F.desc("total"), "empresa").limit(n)
    )


def top_per_column(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """Most frequent non-blank values of each column, from one pass over the table."""
    values = inline_rows(("coluna", "valor"), [(F.lit(c), F.col(f"`{c}`").cast("string")) for c in columns])
    counts = (
        df.select(values).where("valor is not null and trim(valor) <> ''")
        .groupBy("coluna", "valor").agg(F.count(F.lit(1)).alias("registros"))
    )
    order = Window.partitionBy("coluna").orderBy(F.desc("registros"), "valor")
    return counts.withColumn("posicao", F.row_number().over(order)).where(F.col("posicao") <= n)
