"""Text brief of a movement table as rows (secao, ordem, chave, valor)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.numbers import format_fixed
from portolan.functions.shape import inline_rows
from portolan.operators import aggregates, ranking, roles, series


def brief(df: DataFrame, dimensions: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Records, extent, total, top ports and clients, the last six months and the
    change from the last month but one; with dimensions, also their top ten values.
    """
    extent = aggregates.period_extent(df)
    total = df.agg(aggregates.sum0("qtd_container")).scalar()
    head = extent.select(inline_rows(("secao", "ordem", "chave", "valor"), (
        _row("registros", 1, "total", F.col("registros").cast("string")),
        _row("periodo", 1, "inicio", F.date_format("data_min", "dd/MM/yyyy")),
        _row("periodo", 2, "fim", F.date_format("data_max", "dd/MM/yyyy")),
        _row("periodo", 3, "anos", F.col("anos")),
        _row("periodo", 4, "meses", F.col("meses")),
        _row("containers", 1, "total", format_fixed(total, 0)),
    )))
    columns = roles.port_columns(df.columns) + roles.columns_with(df.columns, ("cliente", "consignatario", "exportador", "importador"))
    top = ranking.top_per_column(df, columns, 5).select(
        F.concat(F.lit("principais "), "coluna").alias("secao"), F.col("posicao").alias("ordem"), F.col("valor").alias("chave"),
        F.col("registros").cast("string").alias("valor"))
    months = series.last_periods(df, 6).select(
        F.lit("evolucao").alias("secao"), F.row_number().over(Window.orderBy("ano_mes")).alias("ordem"),
        F.col("ano_mes").cast("string").alias("chave"), format_fixed("total", 0).alias("valor"))
    change = series.last_change(df).where("variacao is not null").select(
        F.lit("variacao").alias("secao"), F.lit(1).alias("ordem"), F.col("ano_mes").cast("string").alias("chave"),
        F.concat(format_fixed("variacao", 1), F.lit("%")).alias("valor"))
    parts = [head, top, months, change]
    if dimensions:
        parts.append(aggregates.drill_down(df, dimensions).select(
            F.concat(F.lit("distribuicao "), "coluna").alias("secao"), F.col("posicao").alias("ordem"),
            F.col("valor").alias("chave"), F.col("registros").cast("string").alias("valor")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _row(section: str, order: int, key: str, value: Column) -> tuple[Column, ...]:
    return F.lit(section), F.lit(order), F.lit(key), value
