"""Linear demand forecast on the month number, calendar month and quarter; of one series, or of every group's."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.dates import parse_year_month
from portolan.functions.numbers import confidence_band, precision_band
from portolan.operators.aggregates import sum0
from portolan.operators.series import monthly_series

FEATURES = ("mes_sequencial", "mes", "trimestre")


def fit(series: DataFrame) -> dict | None:
    """Least squares on the monthly series; minimum norm when the features are
    collinear, None below six months.

    One aggregate row leaves the cluster: the points of the series, twelve a year.
    """
    point = F.struct(*[F.col(f).cast("double").alias(f) for f in FEATURES], "qtd_container")
    row = series.agg(
        F.collect_list(point).alias("pontos"), F.max("data").alias("ultima"), F.max("mes_sequencial").alias("ultimo"),
    ).first()
    if len(row["pontos"]) < 6:
        return None
    points = np.array([tuple(p) for p in row["pontos"]])
    x, y = points[:, :-1], points[:, -1]
    centred = x - x.mean(axis=0)
    beta = np.linalg.pinv(centred, rcond=1e-10) @ (y - y.mean())
    intercept = float(y.mean() - x.mean(axis=0) @ beta)
    error = y - (x @ beta + intercept)
    spread = float(((y - y.mean()) ** 2).sum())
    return {
        "beta": [float(b) for b in beta], "intercepto": intercept, "n": len(y),
        "ultima": row["ultima"], "ultimo": row["ultimo"], "mae": float(np.abs(error).mean()),
        "r2": 1.0 - float((error**2).sum()) / spread if spread else 1.0,
    }


def _predicted(model: dict, values: list[Column]) -> Column:
    result = F.lit(model["intercepto"])
    for b, value in zip(model["beta"], values):
        result = result + F.lit(b) * value
    return result


def forecast(df: DataFrame, months_ahead: int = 3) -> DataFrame:
    """Predictions ``months_ahead`` steps of 30 days past the last month; no rows for
    a series shorter than six months.
    """
    model = fit(monthly_series(df))
    spark = df.sparkSession
    if model is None:
        return spark.createDataFrame([], "passo int, mes string, containers_previstos bigint, mae double, r2 double, "
                                         "precisao string, confianca string, dados_historicos bigint")
    step = F.col("passo")
    day = F.date_add(F.lit(model["ultima"]), step * 30)
    value = _predicted(model, [F.lit(model["ultimo"]) + step, F.month(day), F.quarter(day)])
    r2 = F.lit(model["r2"])
    return spark.range(1, months_ahead + 1).select(F.col("id").cast("int").alias("passo")).select(
        "passo", F.date_format(day, "yyyy-MM").alias("mes"),
        F.greatest(F.lit(0), value.cast("bigint")).alias("containers_previstos"),
        F.bround(F.lit(model["mae"]), 4).alias("mae"), F.bround(r2, 6).alias("r2"),
        precision_band(r2).alias("precisao"), confidence_band(r2).alias("confianca"),
        F.lit(model["n"]).cast("bigint").alias("dados_historicos"),
    )


# Months a series needs, and the share below which a determinant of whole months counts as zero.
LEAST_MONTHS, SINGULAR = 6, 1e-9

Matrix = list[list[Column]]


def _minor(a: Matrix, i: int, j: int) -> Column:
    (p, q), (r, t) = [[a[x][y] for y in range(3) if y != j] for x in range(3) if x != i]
    return p * t - q * r


def _adjugate(a: Matrix) -> Matrix:
    return [[_minor(a, j, i) if (i + j) % 2 == 0 else -_minor(a, j, i) for j in range(3)] for i in range(3)]


def _least_squares(rows: DataFrame) -> DataFrame:
    """Adds b0, b1, b2: the minimum-norm solution of the normal equations a_ij, c_i of every row.

    Features are whole months, so their rank is plain: where the determinant vanishes, the null
    direction v is added as s * v v^T, which changes nothing on the range of the matrix; where only
    one direction is left, the matrix is a multiple of its own projection.
    """
    a = [[F.col(f"a{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    c = [F.col(f"c{i}") for i in range(3)]
    trace = a[0][0] + a[1][1] + a[2][2]
    rows = rows.withColumns({f"j{i}{j}": _adjugate(a)[i][j] for i in range(3) for j in range(i, 3)})
    adjugate = [[F.col(f"j{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    rows = rows.withColumns({"traco": trace, "menores": adjugate[0][0] + adjugate[1][1] + adjugate[2][2], "det": sum(a[0][j] * adjugate[j][0] for j in range(3))})
    rank = F.when(F.col("menores") <= SINGULAR * F.col("traco") ** 2, 1).when(F.col("det") <= SINGULAR * a[0][0] * a[1][1] * a[2][2], 2).otherwise(3)
    rows = rows.withColumn("posto", rank)
    lifted = {f"l{i}{j}": a[i][j] + F.when(F.col("posto") == 2, F.col("traco") * F.try_divide(adjugate[i][j], F.col("menores"))).otherwise(0.0) for i in range(3) for j in range(i, 3)}
    rows = rows.withColumns(lifted)
    whole = [[F.col(f"l{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    inverse = _adjugate(whole)
    determinant = sum(whole[0][j] * inverse[j][0] for j in range(3))
    return rows.withColumns({
        f"b{i}": F.when(F.col("posto") == 1, F.try_divide(sum(a[i][j] * c[j] for j in range(3)), F.col("traco") ** 2)).otherwise(F.try_divide(sum(inverse[i][j] * c[j] for j in range(3)), determinant))
        for i in range(3)})


def forecast_by(df: DataFrame, by: Sequence[str], months_ahead: int = 3, value: str = "qtd_container") -> DataFrame:
    """The forecast of every group: months are summed by group, one aggregate gives each group's normal
    equations, and column arithmetic solves them. Nothing passes through the driver; a group's
    state is its months. Groups of fewer than six months give no rows.
    """
    by = list(by)
    months = df.where(F.col("ano_mes").isNotNull()).groupBy(*by, "ano_mes").agg(sum0(value).alias("y")).withColumn("data", parse_year_month("ano_mes")).where("data IS NOT NULL")
    number = F.row_number().over(Window.partitionBy(*by).orderBy("data")) - 1
    x = ("x0", "x1", "x2")
    points = months.select(*by, "data", F.col("y").cast("double").alias("y"), number.cast("double").alias("x0"), F.month("data").cast("double").alias("x1"), F.quarter("data").cast("double").alias("x2"))
    sums = points.groupBy(*by).agg(
        *[F.covar_pop(x[i], x[j]).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)], *[F.covar_pop(x[i], "y").alias(f"c{i}") for i in range(3)],
        *[F.avg(c).alias(f"m_{c}") for c in (*x, "y")], F.max("x0").alias("ultimo"), F.max("data").alias("ultima"), F.count(F.lit(1)).alias("n"),
        F.collect_list(F.struct(*x, "y")).alias("pontos")).where(F.col("n") >= LEAST_MONTHS)
    solved = _least_squares(sums)
    b = [F.col(f"b{i}") for i in range(3)]
    solved = solved.withColumn("b", F.col("m_y") - sum(b[i] * F.col(f"m_{x[i]}") for i in range(3)))
    errors = F.transform("pontos", lambda p: p["y"] - (F.col("b") + sum(b[i] * p[x[i]] for i in range(3))))
    solved = solved.withColumn("erros", errors)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    spread = total(F.transform("pontos", lambda p: (p["y"] - F.col("m_y")) * (p["y"] - F.col("m_y"))))
    left = total(F.transform("erros", lambda e: e * e))
    # Values that differ from their mean by rounding alone have no spread.
    flat = spread <= 1e-20 * F.col("n") * F.col("m_y") ** 2
    solved = solved.withColumns({"mae": total(F.transform("erros", F.abs)) / F.col("n"), "r2": F.when(flat, 1.0).otherwise(1.0 - F.try_divide(left, spread))})
    step = F.explode(F.sequence(F.lit(1), F.lit(months_ahead))).alias("passo")
    ahead = solved.select(*by, "ultimo", "ultima", "n", "mae", "r2", "b", "b0", "b1", "b2", step).withColumn("dia", F.expr("date_add(ultima, passo * 30)"))
    predicted = F.col("b") + b[0] * (F.col("ultimo") + F.col("passo")) + b[1] * F.month("dia") + b[2] * F.quarter("dia")
    return ahead.select(
        *by, "passo", F.date_format("dia", "yyyy-MM").alias("mes"), F.greatest(F.lit(0), F.bround(predicted, 6).cast("bigint")).alias("containers_previstos"),
        F.bround("mae", 4).alias("mae"), F.bround("r2", 6).alias("r2"), precision_band("r2").alias("precisao"), confidence_band("r2").alias("confianca"), F.col("n").alias("dados_historicos"))
