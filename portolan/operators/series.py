"""Monthly series: windows run only after the table is reduced to one row per month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.dates import parse_year_month
from portolan.functions.numbers import percent_change
from portolan.operators.aggregates import container_total, monthly, sum0, sum_by

MONTHS_PER = {"M": 1, "Q": 3, "Y": 12}
TRUNC = {"M": "month", "Q": "quarter", "Y": "year"}


def monthly_series(df: DataFrame) -> DataFrame:
    """Month totals with calendar features, moving averages and differences."""
    rows = monthly(df).withColumn("data", parse_year_month("ano_mes"))
    order = Window.orderBy("data")

    def moving(n: int) -> Column:
        frame = order.rowsBetween(1 - n, 0)
        return F.when(F.count("qtd_container").over(frame) == n, F.avg("qtd_container").over(frame))

    return rows.select(
        "ano_mes", "qtd_container", "clientes", "data",
        F.month("data").alias("mes"), F.quarter("data").alias("trimestre"), F.year("data").alias("ano"),
        (F.row_number().over(order) - 1).alias("mes_sequencial"),
        moving(3).alias("ma_3"), moving(6).alias("ma_6"),
        (F.col("qtd_container") - F.lag("qtd_container").over(order)).alias("tendencia"),
    )


def resample(df: DataFrame, period: str = "M", value: str = "qtd_container") -> DataFrame:
    """Sums per month, quarter or year; empty periods in between are 0."""
    sums = (
        sum_by(df, "ano_mes", value=value)
        .select(F.trunc(parse_year_month("ano_mes"), TRUNC[period]).alias("periodo"), "total")
        .groupBy("periodo").agg(sum0("total").alias("total"))
    )
    step = F.expr(f"INTERVAL {MONTHS_PER[period]} MONTH")
    calendar = sums.agg(F.min("periodo").alias("a"), F.max("periodo").alias("b")).select(
        F.explode(F.sequence("a", "b", step)).alias("periodo"))
    return calendar.join(sums, "periodo", "left").select("periodo", F.coalesce("total", F.lit(0.0)).alias("total"))


def trend_summary(df: DataFrame, period: str = "M", value: str = "qtd_container") -> DataFrame:
    """First-to-last direction and change, mean, peak and trough of a resampled series."""
    row = resample(df, period, value).agg(
        F.min_by("total", "periodo").alias("primeiro"), F.max_by("total", "periodo").alias("ultimo"),
        F.avg("total").alias("media"), F.max("total").alias("pico"), F.min("total").alias("vale"),
    )
    first, last = F.col("primeiro"), F.col("ultimo")
    return row.select(
        F.when(last > first, "crescente").otherwise("decrescente").alias("tendencia"),
        F.coalesce((F.try_divide(last, first) - 1) * 100, F.lit(0.0)).alias("variacao_total"),
        F.col("media").alias("media_periodo"), "pico", "vale",
    )


def last_periods(df: DataFrame, n: int, value: str = "qtd_container") -> DataFrame:
    """The last n months that have rows."""
    return sum_by(df, "ano_mes", value=value).orderBy(F.desc("ano_mes")).limit(n)


def last_change(df: DataFrame, value: str = "qtd_container") -> DataFrame:
    """Last month against the one before: difference and percentage."""
    order = Window.orderBy("ano_mes")
    rows = last_periods(df, 2, value).withColumn("anterior", F.lag("total").over(order))
    return rows.orderBy(F.desc("ano_mes")).limit(1).select(
        "ano_mes", "total", "anterior", (F.col("total") - F.col("anterior")).alias("diferenca"),
        percent_change(F.col("total"), F.col("anterior")).alias("variacao"),
    )


def recent_direction(df: DataFrame, value: str = "qtd_container") -> DataFrame:
    """Growth or fall from the first to the last of the three last months."""
    row = last_periods(df, 3, value).agg(
        F.count(F.lit(1)).alias("meses"), F.min_by("total", "ano_mes").alias("primeiro"),
        F.max_by("total", "ano_mes").alias("ultimo"),
    )
    return row.select(
        F.when(F.col("meses") < 3, "insuficiente").when(F.col("ultimo") > F.col("primeiro"), "crescimento")
        .otherwise("queda").alias("tendencia"), "primeiro", "ultimo",
    )


def trend_name(mean: Column) -> Column:
    """Label of a mean change in percent."""
    return (
        F.when(mean > 5, "CRESCIMENTO SIGNIFICATIVO").when(mean > 0, "CRESCIMENTO MODERADO")
        .when(mean < -5, "QUEDA SIGNIFICATIVA").when(mean < 0, "QUEDA MODERADA")
        .when(mean == 0, "ESTÁVEL")
    )


def trend_label(df: DataFrame) -> DataFrame:
    """Label from the mean change between the last three months, by the container cascade."""
    totals = df.groupBy("ano_mes").agg(container_total(df.columns).cast("double").alias("total"))
    last = totals.where("ano_mes is not null").orderBy(F.desc("ano_mes")).limit(3)
    before = F.lag("total").over(Window.orderBy("ano_mes"))
    changes = last.select("ano_mes", "total", before.alias("anterior")).withColumn(
        "variacao", F.when(F.col("anterior") > 0, percent_change(F.col("total"), F.col("anterior"))))
    mean = F.avg("variacao")
    return changes.agg(trend_name(mean).alias("tendencia"), F.bround(mean, 6).alias("variacao_media"))


def compare_periods(df: DataFrame, first: int, second: int, category: str = "tipo_operacao") -> DataFrame:
    """Two months side by side, overall and per category (kept when either is above 0)."""
    rows = df.where(F.col("ano_mes").isin(first, second))
    per = rows.groupBy(category, "ano_mes").agg(container_total(df.columns).alias("t"))
    overall = rows.groupBy("ano_mes").agg(container_total(df.columns).alias("t")).withColumn(category, F.lit("total"))

    def side(month: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("ano_mes") == month, F.col("t"))), F.lit(0))

    both = overall.unionByName(per.where(F.col(category).isNotNull())).groupBy(category).agg(
        side(first).alias("total1"), side(second).alias("total2"))
    one, two = F.col("total1"), F.col("total2")
    return both.where((F.col(category) == "total") | (one > 0) | (two > 0)).select(
        F.col(category).alias("categoria"), "total1", "total2", (two - one).alias("diferenca"),
        F.when(one > 0, percent_change(two, one)).when(two == 0, 0.0).alias("variacao"),
    )


def compare_months(df: DataFrame, first: int, second: int, value: str = "qtd_container") -> DataFrame:
    """Difference and percentage (0 when the first month is 0) between two months."""
    def month(m: int) -> Column:
        return sum0(F.when(F.col("ano_mes") == m, F.col(value)))

    row = df.where(F.col("ano_mes").isin(first, second)).agg(month(first).alias("total1"), month(second).alias("total2"))
    return row.select("total1", "total2", (F.col("total2") - F.col("total1")).alias("diferenca"),
                      F.coalesce(percent_change(F.col("total2"), F.col("total1")), F.lit(0.0)).alias("variacao"))


def period_comparisons(df: DataFrame, value: str = "qtd_container") -> DataFrame:
    """Month-on-month, quarter-on-quarter and year-on-year change on gap-filled series."""
    order = Window.orderBy("periodo")

    def against(frame: DataFrame, back: int, name: str) -> DataFrame:
        old = F.lag("total", back).over(order)
        return frame.select("periodo", "total", F.bround(percent_change(F.col("total"), old), 6).alias(name))

    months = resample(df, "M", value)
    mom, yoy = against(months, 1, "mom"), against(months, 12, "yoy").select("periodo", "yoy")
    qoq = against(resample(df, "Q", value), 1, "qoq").select(F.col("periodo").alias("inicio_trimestre"), "qoq")
    quarter = F.trunc("periodo", "quarter")
    return mom.join(yoy, "periodo").join(qoq, quarter == F.col("inicio_trimestre")).select(
        "periodo", "total", "mom", "qoq", "yoy")


def proactive_insights(df: DataFrame) -> DataFrame:
    """Change in the last month, largest client and best calendar month, as rows."""
    from portolan.operators.ranking import top_n

    change = last_change(df).select(
        F.when(F.col("diferenca") > 0, "crescimento").when(F.col("diferenca") < 0, "reducao").otherwise("estavel").alias("tipo"),
        F.col("ano_mes").cast("string").alias("chave"), F.abs("diferenca").alias("valor"),
    )
    enough = sum_by(df, "ano_mes").agg(F.count(F.lit(1)) >= 3).scalar()
    client = top_n(df, "cliente", 1, by="qtd_container").select(
        F.lit("top_cliente").alias("tipo"), F.col("cliente").alias("chave"), "valor")
    best = (
        df.where("mes is not null").groupBy("mes").agg(F.avg("qtd_container").alias("valor"))
        .orderBy(F.desc("valor"), "mes").limit(1)
        .select(F.lit("melhor_mes").alias("tipo"), F.col("mes").cast("string").alias("chave"), "valor")
    )
    return change.where((F.col("tipo") != "estavel") & enough).unionByName(client).unionByName(best)


def seasonality(df: DataFrame, minimum: int = 12) -> DataFrame:
    """Mean month total per calendar month against the overall mean; no rows below 12 months."""
    totals = sum_by(df, "ano_mes").withColumn("mes", (F.col("ano_mes") % 100).cast("int"))
    overall = totals.agg(F.struct(F.avg("total").alias("media"), F.count(F.lit(1)).alias("meses"))).scalar()
    per = totals.groupBy("mes").agg(F.avg("total").alias("media"))
    change = percent_change(F.col("media"), overall["media"])
    every = Window.partitionBy()
    peak = F.row_number().over(Window.orderBy(F.desc("media"), "mes")) == 1
    trough = F.row_number().over(Window.orderBy("media", "mes")) == 1
    return per.where(overall["meses"] >= minimum).select(
        "mes", F.floor("media").alias("media_containers"), F.bround(change, 1).alias("variacao_percentual"),
        F.when(change > 10, "Alto").when(change < -10, "Baixo").otherwise("Normal").alias("classificacao"),
        F.when(peak, "pico").when(trough, "vale").otherwise("").alias("extremo"),
        F.bround((F.max("media").over(every) - F.min("media").over(every)) * 100.0 / overall["media"], 1).alias("amplitude"),
    )
