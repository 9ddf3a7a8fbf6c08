"""Totals and summaries. Grouping keys that are null are dropped; a sum of nothing is 0."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions.numbers import decimal_comma, percent_change
from portolan.functions.shape import inline_rows

# Headers the container cascade looks for, by step.
QUANTITY_COLUMNS = ("QTDE CONTAINER", "QTDE CONTEINER")
SIZE_STEPS = (("C20", "C40"), ("QUANTIDADE C20", "QUANTIDADE C40"))
TEU_COLUMNS = ("QUANTIDADE TEUS", "TEUS")

# The operation types.
OPERATION_TYPES = ("importacao", "exportacao", "cabotagem")

# Metric columns a total reports when the table has them.
METRIC_COLUMNS = ("VOLUMES", "VOLUME (M³)", "PESO BRUTO")

# Dimensions of the drill-down.
DIMENSIONS = {
    "geografica": ("PAÍS", "PORTO", "CIDADE", "ESTADO"),
    "temporal": ("ANO/MÊS", "DATA"),
    "comercial": ("CLIENTE", "ARMADOR", "AGENTE DE CARGA"),
    "operacional": ("TIPO CARGA", "TIPO CONTEINER", "TERMINAL"),
}

# Columns per aggregate of the declared aggregate set.
AGGREGATE_SET = {
    "sum": ("qtd_container", "TEUS", "VOLUMES", "PESO BRUTO"),
    "count": ("ID",),
    "unique": ("NAVIO", "VIAGEM", "ARMADOR"),
    "first": ("DATA EMBARQUE", "ETA", "ETS"),
}


def sum0(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def _sum_text(name: str) -> Column:
    return sum0(F.coalesce(decimal_comma(F.col(f"`{name}`")), F.lit(0.0)))


def container_total(columns: Sequence[str]) -> Column:
    """Containers of a group as one aggregate expression.

    A quantity column wins when the table has one. Otherwise 20' boxes count once
    and 40' boxes twice; a group where that gives 0 falls to the next pair of size
    columns, then to the first TEU column. Truncated to a whole number.
    """
    for name in QUANTITY_COLUMNS:
        if name in columns:
            return _sum_text(name).cast("bigint")
    teu = next((name for name in TEU_COLUMNS if name in columns), None)
    total = _sum_text(teu) if teu else F.lit(0.0)
    for small, large in reversed(SIZE_STEPS):
        parts = []
        if small in columns:
            parts.append(_sum_text(small))
        if large in columns:
            parts.append(_sum_text(large) * 2)
        if parts:
            step = sum(parts[1:], parts[0])
            total = F.when(step != 0, step).otherwise(total)
    return total.cast("bigint")


def total_containers(df: DataFrame) -> DataFrame:
    return df.agg(container_total(df.columns).alias("total_containers"))


def total_containers_by(df: DataFrame, *keys: str) -> DataFrame:
    """The container cascade decided inside each group."""
    return _present(df, keys).groupBy(*keys).agg(container_total(df.columns).alias("total_containers"))


def _present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        df = df.where(F.col(f"`{key}`").isNotNull())
    return df


def sum_by(df: DataFrame, *keys: str, value: str = "qtd_container") -> DataFrame:
    return _present(df, keys).groupBy(*keys).agg(sum0(value).alias("total"))


def group_summary(df: DataFrame, key: str = "cliente", value: str = "qtd_container") -> DataFrame:
    """Sum, count and mean per key."""
    return _present(df, [key]).groupBy(key).agg(
        sum0(value).alias("total"), F.count(value).alias("operacoes"), F.avg(value).alias("media")
    )


def monthly(df: DataFrame, value: str = "qtd_container") -> DataFrame:
    """Containers and distinct clients per month."""
    return _present(df, ["ano_mes"]).groupBy("ano_mes").agg(
        sum0(value).alias("qtd_container"), F.count_distinct("cliente").alias("clientes")
    )


def kpi_block(df: DataFrame) -> DataFrame:
    """Total, operations, distinct clients and the total per operation as rows.

    Both halves read one reduction by operation and client, so the table is
    scanned and shuffled once.
    """
    base = df.groupBy("tipo_operacao", "cliente").agg(
        sum0("qtd_container").alias("q"), F.count(F.lit(1)).alias("n")
    )
    totals = base.agg(
        sum0("q").alias("q"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"),
        F.count_distinct("cliente").cast("double").alias("c"),
    ).select(inline_rows(("metrica", "chave", "valor"), (
        (F.lit("total_containers"), F.lit(""), F.col("q")),
        (F.lit("total_operacoes"), F.lit(""), F.col("n")),
        (F.lit("clientes_unicos"), F.lit(""), F.col("c")),
    )))
    by_operation = base.where("tipo_operacao is not null").groupBy("tipo_operacao").agg(sum0("q").alias("valor")).select(
        F.lit("por_operacao").alias("metrica"), F.col("tipo_operacao").alias("chave"), "valor"
    )
    return totals.unionByName(by_operation)


def kpi_cards(df: DataFrame, as_of: datetime.date) -> DataFrame:
    """Figures of the month of ``as_of`` and the change from the month before (0 when that is 0)."""
    current = as_of.year * 100 + as_of.month
    before = current - 1 if as_of.month > 1 else (as_of.year - 1) * 100 + 12
    now, prev = F.col("ano_mes") == current, F.col("ano_mes") == before
    sums = df.where(F.col("ano_mes").isin(current, before)).agg(
        sum0(F.when(now, F.col("qtd_container"))).alias("total_containers"),
        F.count_if(now).alias("total_operacoes"),
        F.count_distinct(F.when(now, F.col("cliente"))).alias("clientes_unicos"),
        sum0(F.when(prev, F.col("qtd_container"))).alias("anterior"),
    )
    total, anterior = F.col("total_containers"), F.col("anterior")
    return sums.select(
        "total_containers", "total_operacoes", "clientes_unicos",
        F.coalesce(F.try_divide(total, F.col("total_operacoes")), F.lit(0.0)).alias("media_por_operacao"),
        F.when(anterior > 0, percent_change(total, anterior)).otherwise(0.0).alias("variacao"),
    )


def performance(df: DataFrame, as_of: datetime.date) -> DataFrame:
    """Containers, operations and clients of the month, the year and each operation of the year."""
    year = df.where(F.col("ano") == as_of.year)
    month = F.col("mes") == as_of.month
    base = year.groupBy("tipo_operacao", "cliente").agg(
        sum0("qtd_container").alias("q"), F.count(F.lit(1)).alias("n"),
        sum0(F.when(month, F.col("qtd_container"))).alias("qm"), F.count_if(month).alias("nm"),
    )

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    scopes = base.agg(
        sum0("qm").alias("qm"), total("nm").alias("nm"),
        F.count_distinct(F.when(F.col("nm") > 0, F.col("cliente"))).alias("cm"),
        sum0("q").alias("q"), total("n").alias("n"), F.count_distinct("cliente").alias("c"),
    ).select(inline_rows(("escopo", "chave", "containers", "operacoes", "clientes_unicos"), (
        (F.lit("mensal_atual"), F.lit(""), F.col("qm"), F.col("nm"), F.col("cm")),
        (F.lit("anual"), F.lit(""), F.col("q"), F.col("n"), F.col("c")),
    )))
    by_operation = base.where("tipo_operacao is not null").groupBy("tipo_operacao").agg(
        sum0("q").alias("containers"), F.sum("n").alias("operacoes")
    ).select(F.lit("por_operacao").alias("escopo"), F.col("tipo_operacao").alias("chave"), "containers", "operacoes",
             F.lit(None).cast("bigint").alias("clientes_unicos"))
    return scopes.unionByName(by_operation)


def metric_totals(df: DataFrame, columns: Sequence[str] = METRIC_COLUMNS) -> DataFrame:
    """Sums of the metric columns the table has, as rows."""
    found = [c for c in columns if c in df.columns]
    sums = df.agg(*[sum0(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(found)])
    return sums.select(inline_rows(("metrica", "total"), [(F.lit(c), F.col(f"s{i}")) for i, c in enumerate(found)]))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return _present(df, [column]).groupBy(F.col(column).alias("valor")).agg(F.count(F.lit(1)).alias("registros"))


def share_by(df: DataFrame, key: str, value: str = "qtd_container") -> DataFrame:
    """Total per key and its percentage of all of them."""
    totals = sum_by(df, key, value=value)
    whole = totals.agg(F.sum("total")).scalar()
    return totals.select(key, "total", (F.try_divide(F.col("total"), whole) * 100).alias("percentual"))


def mean_of_months(df: DataFrame, value: str = "qtd_container") -> DataFrame:
    return sum_by(df, "ano_mes", value=value).agg(F.avg("total").alias("media_mensal"), sum0("total").alias("total"))


def period_extent(df: DataFrame) -> DataFrame:
    """First and last date and the years and months seen (both short lists)."""
    months = df.groupBy("ano", "mes").agg(
        F.min("data_embarque").alias("a"), F.max("data_embarque").alias("b"), F.count(F.lit(1)).alias("n")
    )
    return months.agg(
        F.min("a").alias("data_min"), F.max("b").alias("data_max"), F.sum("n").alias("registros"),
        F.concat_ws(",", F.sort_array(F.collect_set("ano"))).alias("anos"),
        F.concat_ws(",", F.sort_array(F.collect_set("mes"))).alias("meses"),
    )


def agg_by_config(
    df: DataFrame, keys: Sequence[str], config: Mapping[str, Sequence[str]] = AGGREGATE_SET, order: str = "data_embarque"
) -> DataFrame:
    """Declared aggregates over the columns the table has; 'first' means earliest by ``order``."""
    def picked(kind: str) -> list[str]:
        return [c for c in config.get(kind, ()) if c in df.columns]

    measures = [sum0(F.col(f"`{c}`")).alias(f"sum_{c}") for c in picked("sum")]
    measures += [F.count(F.col(f"`{c}`")).alias(f"count_{c}") for c in picked("count")]
    measures += [F.count_distinct(F.col(f"`{c}`")).alias(f"unique_{c}") for c in picked("unique")]
    measures += [F.min_by(F.col(f"`{c}`"), F.struct(order, F.col(f"`{c}`"))).alias(f"first_{c}") for c in picked("first")]
    return _present(df, keys).groupBy(*keys).agg(*measures)


def drill_down(df: DataFrame, dimensions: Mapping[str, Sequence[str]] = DIMENSIONS, top: int = 10) -> DataFrame:
    """Top values of every dimension column the table has, by record count."""
    from portolan.operators.ranking import top_per_column

    found = [(dimension, c) for dimension, cs in dimensions.items() for c in cs if c in df.columns]
    ranked = top_per_column(df, [c for _, c in found], top)
    label = F.lit(None).cast("string")
    for dimension, c in found:
        label = F.when(F.col("coluna") == c, dimension).otherwise(label)
    return ranked.select(label.alias("dimensao"), "coluna", "valor", "registros", "posicao")


def metric_block(df: DataFrame, as_of: datetime.date) -> DataFrame:
    """Total containers, active clients and growth rate for the period up to ``as_of``."""
    cards = kpi_cards(df, as_of)
    return cards.select(
        F.col("total_containers"), F.col("clientes_unicos").alias("clientes_ativos"),
        F.bround("variacao", 6).alias("taxa_crescimento"), F.lit(f"{as_of:%Y-%m}").alias("periodo"),
    )
