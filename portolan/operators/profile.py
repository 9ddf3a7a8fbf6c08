"""Distributions, column profiles and data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions.numbers import to_number
from portolan.functions.shape import inline_rows
from portolan.operators.aggregates import sum0

# Columns an integrity check requires.
KEY_COLUMNS = ("qtd_container", "cliente", "ano_mes")

# Rank error of the bracket sketch is at most 1 / ACCURACY of the rows.
ACCURACY = 10_000

# Parts of equal width that a bracket is cut into; at most so many rows per key and probability are broadcast.
SLOTS = 1024


def exact_quantiles(values: DataFrame, probabilities: Sequence[float], key: str = "coluna", value: str = "valor") -> DataFrame:
    """Exact, linearly interpolated quantiles per key: rows (key, p, quantil).

    No task ever holds all distinct values of a key. A mergeable sketch brackets
    each rank, values outside a bracket are only counted, values inside are counted
    by slots, and just the slots that hold the rank are ordered. There is one bracket per key and probability; keys
    are column names, so their broadcast is bounded by the width of the table.
    """
    values = values.select(key, F.col(value).cast("double").alias("v")).where("v is not null")
    histogram = values.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))
    margin = 4.0 / ACCURACY
    bounds = [min(max(q, 0.0), 1.0) for p in probabilities for q in (p - margin, p + margin)]
    sketch = values.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.percentile_approx("v", bounds, ACCURACY).alias("b"),
        F.min("v").alias("lo"), F.max("v").alias("hi"),
    )
    last = F.col("total") - 1
    brackets = sketch.select(key, inline_rows(("p", "rank", "a", "z"), [
        (F.lit(float(p)), last * F.lit(float(p)),
         F.col("lo") if p - margin <= 0 else F.col("b")[2 * i],
         F.col("hi") if p + margin >= 1 else F.col("b")[2 * i + 1]) for i, p in enumerate(probabilities)]))
    placed = histogram.join(F.broadcast(brackets), key).select(key, "v", "n", "p", "rank", "a", "z")
    outside = placed.where("v < a or v > z").groupBy(key, "p").agg(
        F.sum(F.when(F.col("v") < F.col("a"), F.col("n"))).alias("below"),
        F.max(F.when(F.col("v") < F.col("a"), F.col("v"))).alias("before"),
        F.min(F.when(F.col("v") > F.col("z"), F.col("v"))).alias("after"),
    )
    # The bracket's rows are summed by slots of equal width; only the slots that hold a wanted rank are ordered.
    width = F.when(F.col("z") > F.col("a"), F.least(F.lit(SLOTS - 1), F.floor((F.col("v") - F.col("a")) / (F.col("z") - F.col("a")) * SLOTS))).otherwise(F.lit(0))
    inside = placed.where("v between a and z").withColumn("slot", F.coalesce(width, F.lit(0)).cast("int"))
    slots = inside.groupBy(key, "p", "rank", "slot").agg(F.sum("n").alias("c")).join(F.broadcast(outside.select(key, "p", "below")), [key, "p"], "left")
    upto = Window.partitionBy(key, "p").orderBy("slot")
    below = F.coalesce("below", F.lit(0))
    slots = slots.withColumn("base", F.sum("c").over(upto) - F.col("c")).withColumn("end", F.max("slot").over(Window.partitionBy(key, "p")))
    holds = (F.col("base") + below <= F.ceil("rank")) & (F.col("base") + F.col("c") + below > F.floor("rank"))
    # The outermost slots stay too: they stand for a rank just outside the bracket.
    slots = slots.where(holds | (F.col("base") == 0) | (F.col("slot") == F.col("end"))).select(key, "p", "slot", "base")
    inside = inside.join(F.broadcast(slots), [key, "p", "slot"])
    inside = inside.withColumn("cum", F.col("base") + F.sum("n").over(Window.partitionBy(key, "p", "slot").orderBy("v")))

    def at(rank: Column) -> Column:
        """Value at a rank; the bracket is at most one row short on either side."""
        first = F.min(F.when(F.col("cum") + below > rank, F.col("v")))
        return F.when(F.first(rank < below), F.first("before")).otherwise(F.coalesce(first, F.first("after")))

    found = inside.join(F.broadcast(outside), [key, "p"], "left").groupBy(key, "p", "rank").agg(
        at(F.floor("rank")).alias("x"), at(F.ceil("rank")).alias("y"))
    weight = F.col("rank") - F.floor("rank")
    return found.select(key, "p", (F.col("x") + (F.col("y") - F.col("x")) * weight).alias("quantil"))


def quantile_columns(values: DataFrame, named: dict[str, float], key: str = "coluna", value: str = "valor") -> DataFrame:
    """exact_quantiles with one column per named probability."""
    long = exact_quantiles(values, list(named.values()), key, value)
    return long.groupBy(key).agg(*[
        F.max(F.when(F.col("p") == float(p), F.col("quantil"))).alias(name) for name, p in named.items()
    ])


def column_quantiles(df: DataFrame, column: str, **named: float) -> DataFrame:
    """One row with a column per named quantile of a single column."""
    values = df.select(inline_rows(("coluna", "valor"), [(F.lit(column), F.col(column))]))
    return quantile_columns(values, named).drop("coluna")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max of every numeric column."""
    names = list(columns or numeric_columns(df))
    values = df.select(inline_rows(("coluna", "valor"), [(F.lit(c), F.col(c).cast("double")) for c in names]))
    moments = values.groupBy("coluna").agg(
        F.count("valor").alias("n"), F.bround(F.avg("valor"), digits).alias("media"),
        F.bround(F.stddev_samp("valor"), digits).alias("desvio_padrao"),
        F.min("valor").alias("minimo"), F.max("valor").alias("maximo"),
    )
    quartiles = quantile_columns(values, {"q1": 0.25, "mediana": 0.5, "q3": 0.75})
    rounded = quartiles.select("coluna", *[F.bround(c, digits).alias(c) for c in ("q1", "mediana", "q3")])
    return moments.join(F.broadcast(rounded), "coluna", "left")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return describe(df, [column], digits=6).drop("coluna", "n")


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("linhas")).withColumn("colunas", F.lit(len(df.columns)))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, samples: int = 5) -> DataFrame:
    """Type, non-null count, distinct count and the smallest values of every column."""
    names = list(columns or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    values = df.select(inline_rows(("coluna", "valor"), [(F.lit(c), F.col(f"`{c}`").cast("string")) for c in names]))
    counts = values.groupBy("coluna", "valor").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("coluna").agg(
        F.coalesce(F.sum(F.when(F.col("valor").isNotNull(), F.col("n"))), F.lit(0)).alias("preenchidos"),
        F.count("valor").alias("distintos"),
    )
    first = Window.partitionBy("coluna").orderBy("valor")
    examples = (
        counts.where("valor is not null").withColumn("r", F.row_number().over(first)).where(F.col("r") <= samples)
        .groupBy("coluna").agg(F.concat_ws(", ", F.sort_array(F.collect_list("valor"))).alias("exemplos"))
    )
    kind = F.lit(None).cast("string")
    for c in names:
        kind = F.when(F.col("coluna") == c, types[c]).otherwise(kind)
    return totals.join(F.broadcast(examples), "coluna", "left").withColumn("tipo", kind)


def quantity_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sum, mean and valid count of every quantity column, numbers read leniently."""
    parts = []
    for i, c in enumerate(columns):
        number = to_number(F.col(f"`{c}`"))
        parts += [sum0(number).alias(f"s{i}"), F.avg(number).alias(f"a{i}"), F.count(number).alias(f"n{i}")]
    rows = [(F.lit(c), F.col(f"s{i}"), F.col(f"a{i}"), F.col(f"n{i}")) for i, c in enumerate(columns)]
    return df.agg(*parts).select(inline_rows(("coluna", "total", "media", "validos"), rows))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical row."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copias"))
    return groups.agg(F.coalesce(F.sum(F.col("copias") - 1), F.lit(0)).alias("duplicados"))


def _outlier_count(df: DataFrame, column: str) -> Column:
    """Aggregate: rows strictly outside 1.5 quartile ranges of the whole table."""
    quartiles = column_quantiles(df, column, q1=0.25, q3=0.75).select(F.struct("q1", "q3")).scalar()
    q1, q3 = quartiles["q1"], quartiles["q3"]
    reach = (q3 - q1) * 1.5
    return F.count_if((F.col(column) < q1 - reach) | (F.col(column) > q3 + reach))


def outliers(df: DataFrame, column: str = "qtd_container") -> DataFrame:
    """Outlying rows, and whether they exceed 5 % of all."""
    counts = df.agg(_outlier_count(df, column).alias("outliers"), F.count(F.lit(1)).alias("registros"))
    return counts.withColumn("excede_5pct", F.col("outliers") > F.col("registros") * 0.05)


def _completeness(columns: Sequence[str]) -> Column:
    """Aggregate: mean over the columns of the percentage of non-null values."""
    shares = [F.try_divide(F.count(F.col(f"`{c}`")) * F.lit(100.0), F.count(F.lit(1))) for c in columns]
    return sum(shares[1:], shares[0]) / len(shares)


def completeness(df: DataFrame) -> DataFrame:
    return df.agg(_completeness(df.columns).alias("completude"))


def _bad_periods(column: str) -> Column:
    """Aggregate: periods whose text is not six characters long; a missing one counts."""
    return F.count_if(F.length(F.coalesce(F.col(column).cast("string"), F.lit("nan"))) != 6)


def quality_score(df: DataFrame, quantity: str = "qtd_container", period: str = "ano_mes") -> DataFrame:
    """Score from 100 down, with the figures behind every deduction; 0 for an empty table."""
    row = df.agg(
        F.count(F.lit(1)).alias("registros"), _outlier_count(df, quantity).alias("outliers"),
        _bad_periods(period).alias("periodos_invalidos"), _completeness(df.columns).alias("completude"),
    ).withColumn("duplicados", duplicate_rows(df).scalar())
    score = (
        F.lit(100)
        - F.when(F.col("duplicados") > 0, 10).otherwise(0)
        - F.when(F.col("periodos_invalidos") > 0, 15).otherwise(0)
        - F.when(F.col("outliers") > F.col("registros") * 0.05, 5).otherwise(0)
        - F.when(F.col("completude") < 90, 20).otherwise(0)
    )
    return row.select(
        F.when(F.col("registros") == 0, 0).otherwise(score).alias("score"),
        "duplicados", "periodos_invalidos", "outliers", F.bround("completude", 6).alias("completude"),
    )


def integrity(df: DataFrame, required: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """Missing columns, nulls in key columns, negatives, period range and clients, in one pass."""
    found = [c for c in required if c in df.columns]
    missing = [c for c in required if c not in df.columns]

    def measure(column: str, expression: Column, kind: str) -> Column:
        return expression if column in found else F.lit(None).cast(kind)

    row = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulos_{c}") for c in found],
        measure("qtd_container", F.count_if(F.col("qtd_container") < 0), "bigint").alias("negativos"),
        measure("ano_mes", F.min("ano_mes").cast("string"), "string").alias("periodo_min"),
        measure("ano_mes", F.max("ano_mes").cast("string"), "string").alias("periodo_max"),
        measure("cliente", F.count_distinct("cliente"), "bigint").alias("unique_clients"),
    )
    return row.select(
        "*", F.lit(", ".join(missing)).alias("colunas_ausentes"),
        ((F.col("total_records") > 0) & F.lit(not missing)).alias("valid"),
    )


def security_score(df: DataFrame) -> DataFrame:
    """Quality and integrity in one figure, at most 100."""
    valid = integrity(df).select("valid").scalar()
    quality = quality_score(df)
    combined = (F.col("score") + F.when(valid, 100).otherwise(50)) / 2.0
    return quality.select(F.least(F.lit(100.0), combined).alias("security_score"), F.col("score"), valid.alias("valid"))


def first_rows(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first rows in a stated order, as a preview beside the profile."""
    return df.orderBy(*order).limit(n)
