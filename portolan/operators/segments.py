"""Client metrics, opportunity rules and lifetime value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.dates import months_between_starts, parse_year_month
from portolan.functions.numbers import format_fixed
from portolan.operators import forecast as fc
from portolan.operators import series
from portolan.operators.aggregates import sum0, sum_by
from portolan.operators.profile import column_quantiles

LOW_SHARE = 0.7
MIN_OPERATIONS = 5


def client_metrics(df: DataFrame) -> DataFrame:
    """Sum, count, mean, first and last month of every client."""
    return df.where("cliente is not null").groupBy("cliente").agg(
        sum0("qtd_container").alias("total_containers"), F.count("qtd_container").alias("num_operacoes"),
        F.avg("qtd_container").alias("media_containers"),
        F.min("ano_mes").alias("primeiro_mes"), F.max("ano_mes").alias("ultimo_mes"),
    )


def upsell(df: DataFrame) -> DataFrame:
    """Frequent clients whose total lies below the median client's."""
    clients = client_metrics(df).select("cliente", "total_containers", "num_operacoes")
    median = column_quantiles(clients, "total_containers", mediana=0.5).scalar()
    return clients.where((F.col("num_operacoes") >= MIN_OPERATIONS) & (F.col("total_containers") < median))


def low_months(df: DataFrame) -> DataFrame:
    """Months of the series below 70 % of the mean month."""
    months = sum_by(df, "ano_mes")
    mean = months.agg(F.avg("total")).scalar()
    return months.where(F.col("total") < mean * LOW_SHARE).select(
        F.date_format(parse_year_month("ano_mes"), "yyyy-MM").alias("periodo"), "total")


def low_calendar_months(df: DataFrame) -> DataFrame:
    """Calendar months, over all years, below 70 % of their mean."""
    months = sum_by(df, "mes")
    mean = months.agg(F.avg("total")).scalar()
    return months.where(F.col("total") < mean * LOW_SHARE).select("mes", "total", mean.alias("media"))


def small_operations(df: DataFrame, limit: float = 20.0) -> DataFrame:
    """Operations with less than 20 % of the volume."""
    totals = sum_by(df, "tipo_operacao")
    share = F.try_divide(F.col("total"), totals.agg(F.sum("total")).scalar()) * 100
    return totals.select("tipo_operacao", "total", share.alias("participacao")).where(F.col("participacao") < limit)


# The types, potentials and texts of the findings below.
def opportunities(df: DataFrame, limit: int | None = None) -> DataFrame:
    """All client, month and operation findings, in that order; ``limit`` keeps so many of each type."""
    clients = upsell(df).select(
        F.lit(1).alias("ordem"), F.col("cliente").alias("chave"), F.lit("upsell_cliente").alias("tipo"),
        F.lit("Alto").alias("potencial"),
        F.format_string("Cliente frequente (%d ops) com volume baixo", F.col("num_operacoes")).alias("descricao"))
    months = low_months(df).select(
        F.lit(2).alias("ordem"), F.col("periodo").alias("chave"), F.lit("sazonalidade").alias("tipo"),
        F.lit("Médio").alias("potencial"),
        F.concat(F.lit("Mês com volume "), format_fixed("total", 0), F.lit(" (70% abaixo da média)")).alias("descricao"))
    operations = small_operations(df).select(
        F.lit(3).alias("ordem"), F.col("tipo_operacao").alias("chave"), F.lit("diversificacao_operacao").alias("tipo"),
        F.lit("Alto").alias("potencial"),
        F.concat(F.lit("Operação "), "tipo_operacao", F.lit(" representa apenas "), format_fixed("participacao", 1), F.lit("% do volume")).alias("descricao"))
    return _some_of_each([clients, months, operations], ["chave"], limit).orderBy("ordem", "chave")


def _some_of_each(findings: list[DataFrame], order: list[str], limit: int | None) -> DataFrame:
    kept = findings if limit is None else [f.orderBy(*order).limit(limit) for f in findings]
    return reduce(DataFrame.unionByName, kept)


def commercial_opportunities(df: DataFrame, limit: int | None = None) -> DataFrame:
    """All client and calendar-month findings; ``limit`` keeps so many of each type."""
    clients = upsell(df).select(
        F.lit(1).alias("ordem"), F.lit(0).alias("mes"), F.col("cliente").alias("chave"), F.lit("upsell").alias("tipo"),
        F.lit("Alto").alias("potencial"))
    months = low_calendar_months(df).select(
        F.lit(2).alias("ordem"), "mes", F.format_string("Mês %d", "mes").alias("chave"), F.lit("sazonalidade").alias("tipo"),
        F.lit("Médio").alias("potencial"))
    return _some_of_each([clients, months], ["mes", "chave"], limit).orderBy("ordem", "mes", "chave").drop("mes")


def lifetime_value(df: DataFrame) -> DataFrame:
    """Mean per operation times the months between first and last movement."""
    first, last = parse_year_month("primeiro_mes"), parse_year_month("ultimo_mes")
    months = F.coalesce(months_between_starts(first, last), F.lit(1.0))
    return client_metrics(df).withColumn("duracao_meses", months).select(
        "cliente", "total_containers", "media_containers", "duracao_meses",
        (F.col("media_containers") * F.col("duracao_meses")).alias("clv_score"))


def top_lifetime_value(df: DataFrame, n: int = 10) -> DataFrame:
    return lifetime_value(df).orderBy(F.desc("clv_score"), "cliente").limit(n).select(
        "cliente", F.bround("clv_score", 2).alias("clv_score"), F.col("total_containers").cast("bigint").alias("total_containers"),
        F.bround("duracao_meses", 1).alias("duracao_meses"), F.bround("media_containers", 1).alias("avg_mensal"))


def mean_lifetime_value(df: DataFrame) -> DataFrame:
    return lifetime_value(df).agg(
        F.bround(F.avg("clv_score"), 2).alias("clv_medio"), F.bround(F.avg("duracao_meses"), 1).alias("duracao_media"),
        F.bround(F.avg("media_containers"), 1).alias("containers_medio_mensal"))


def commercial_insights(df: DataFrame) -> DataFrame:
    """Next forecast, seasonal peak, number of upsell findings and mean duration, as rows."""
    nxt = fc.forecast(df, 1).select(
        F.lit(1).alias("ordem"), F.lit("previsao").alias("tipo"), F.col("mes").alias("chave"),
        F.col("containers_previstos").cast("double").alias("valor"))
    peak = series.seasonality(df).where("extremo = 'pico'").select(
        F.lit(2).alias("ordem"), F.lit("pico_sazonal").alias("tipo"), F.col("mes").cast("string").alias("chave"),
        F.col("media_containers").cast("double").alias("valor"))
    found = upsell(df).agg(F.count(F.lit(1)).cast("double").alias("valor")).where(
        "valor > 0").select(F.lit(3).alias("ordem"), F.lit("upsell").alias("tipo"), F.lit("").alias("chave"), "valor")
    duration = mean_lifetime_value(df).select(
        F.lit(4).alias("ordem"), F.lit("duracao_media").alias("tipo"), F.lit("").alias("chave"),
        F.col("duracao_media").alias("valor"))
    return nxt.unionByName(peak).unionByName(found).unionByName(duration)
