"""Filters: every operator folds into one predicate, so Catalyst can push it down."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions.dates import parse_period
from portolan.functions.shape import inline_rows
from portolan.functions.text import any_of, contains_text, fold_accents, normalize_text
from portolan.operators import roles

# Month names as they appear in period texts.
MONTH_NAMES = ("janeiro", "fevereiro", "março", "abril", "maio", "junho",
               "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


@dataclass(frozen=True)
class FilterSet:
    """Optional conditions on a movement table; unset ones do not filter."""

    categoria: str | None = None
    cliente: str | None = None
    porto: str | None = None
    armador: str | None = None
    ano: int | None = None
    mes: int | None = None
    data_inicio: int | None = None
    data_fim: int | None = None


def operation_equals(c: Column | str, value: str) -> Column:
    """Same operation, whatever the case and accents on either side."""
    return normalize_text(c) == normalize_text(F.lit(value))


def any_column_equals(columns: Sequence[str], value: str) -> Column:
    """Equal, ignoring case, in at least one of the columns."""
    return any_of(F.coalesce(F.lower(F.col(c)) == F.lower(F.lit(value)), F.lit(False)) for c in columns)


def any_column_contains(columns: Sequence[str], needle: str) -> Column:
    """Literal text, ignoring case, in at least one of the columns; nulls never match."""
    return any_of(contains_text(c, needle) for c in columns)


def date_bounds(dates: str | None, first: int, last: int) -> Column:
    """Dates of a column from the first to the last month (as 199803): a bound that scans can prune by; None bounds nothing."""
    if dates is None:
        return F.lit(True)
    begin = datetime.date(first // 100, first % 100, 1)
    end = datetime.date(last // 100 + last % 100 // 12, last % 100 % 12 + 1, 1)
    return (F.col(dates) >= F.lit(begin)) & (F.col(dates) < F.lit(end))


def filter_condition(columns: Sequence[str], f: FilterSet, operation: str = "tipo_operacao", dates: str | None = None) -> Column:
    """One predicate for a filter set, over the columns the table has.

    dates: the date column that year, month and period were taken from, where they were; periods then
    bound it too.
    """
    conditions = [F.lit(True)]
    if f.ano:
        months = (f.mes, f.mes) if f.mes else (1, 12)
        conditions.append(date_bounds(dates, *[f.ano * 100 + m for m in months]))
    if f.data_inicio and f.data_fim:
        conditions.append(date_bounds(dates, f.data_inicio, f.data_fim))
    if f.categoria:
        conditions.append(operation_equals(operation, f.categoria))
    if f.cliente:
        conditions.append(any_column_equals(roles.client_columns(columns), f.cliente))
    if f.porto:
        conditions.append(any_column_equals(roles.port_columns(columns), f.porto))
    if f.armador:
        conditions.append(F.lower(F.col("armador")) == F.lower(F.lit(f.armador)))
    if f.ano:
        conditions.append(F.col("ano") == f.ano)
    if f.mes:
        conditions.append(F.col("mes") == f.mes)
    if f.data_inicio and f.data_fim:
        conditions.append(F.col("ano_mes").between(f.data_inicio, f.data_fim))
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


def apply_filters(df: DataFrame, f: FilterSet, operation: str = "tipo_operacao", dates: str | None = None) -> DataFrame:
    return df.where(filter_condition(df.columns, f, operation, dates))


def filter_by_period(df: DataFrame, start: datetime.date, end: datetime.date) -> DataFrame:
    """Closed date range on the first date column, else on year and month.

    A table with year and month beside the date takes the date, which scans can prune by.
    """
    for field in df.schema.fields:
        if "data" in field.name.lower() and isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return df.where(F.col(field.name).between(F.lit(start), F.lit(end)))
    if {"ano", "mes"} <= set(df.columns):
        period = F.col("ano") * 100 + F.col("mes")
        return df.where(period.between(start.year * 100 + start.month, end.year * 100 + end.month))
    return df


def year_column(columns: Sequence[str]) -> Column:
    """Year as INT from a year column, else from any period column."""
    if "ano" in columns:
        return F.col("ano").try_cast("int")
    periods = [c for c in columns if any(w in c.lower() for w in ("ano_mes", "ano/mes", "periodo"))]
    return F.coalesce(*[F.year(parse_period(c)) for c in periods]) if periods else F.lit(None).cast("int")


def filter_year(df: DataFrame, year: int, dates: str | None = None) -> DataFrame:
    """Rows of a year. dates: the date column that the year was taken from, where it was; it is bounded too."""
    return df.where((year_column(df.columns) == year) & date_bounds(dates, year * 100 + 1, year * 100 + 12))


def month_year_text(c: Column | str, month: int, year: int) -> Column:
    """Period text holding the month in one of four notations."""
    text = F.col(c) if isinstance(c, str) else c
    notations = (f"{month:02d}/{year}", f"{year}-{month:02d}", f"{year}{month:02d}", f"{month:02d}-{year}")
    return any_of(contains_text(text.cast("string"), n) for n in notations)


def filter_month_year(df: DataFrame, month: int, year: int, period: str = "periodo") -> DataFrame:
    """Month and year from their own columns, else from a period text."""
    if {"ano", "mes"} <= set(df.columns):
        return df.where((F.col("ano").try_cast("int") == year) & (F.col("mes").try_cast("int") == month))
    return df.where(month_year_text(period, month, year))


def is_import(c: Column | str) -> Column:
    text = fold_accents(c)
    return F.coalesce(text.rlike("^i$") | F.contains(text, F.lit("imp")), F.lit(False))


def is_export(c: Column | str) -> Column:
    text = fold_accents(c)
    return F.coalesce(text.rlike("^e$") | F.contains(text, F.lit("exp")), F.lit(False))


def filter_port(df: DataFrame, port: str, loading_only: bool = False) -> DataFrame:
    """Rows naming the port in any port column, or in the loading-port ones only."""
    pick = roles.loading_port_columns if loading_only else roles.port_columns
    return df.where(any_column_contains(pick(df.columns), port))


# The six notations of a month in period texts.
def month_notations(month: int, year: int) -> list[str]:
    name = MONTH_NAMES[month - 1]
    return [f"{year}-{month:02d}", f"{month:02d}/{year}", name, f"{name[:3]}/{year % 100:02d}",
            f"{year}/{month:02d}", f"{month:02d}-{year}"]


def pattern_census(df: DataFrame, columns: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """Rows per (column, text pattern) from one pass; pairs without rows are left out."""
    pairs = [(c, p) for c in columns for p in patterns]
    counts = df.agg(*[
        F.count_if(contains_text(F.col(c).cast("string"), p)).alias(f"n{i}") for i, (c, p) in enumerate(pairs)
    ])
    rows = [(F.lit(c), F.lit(p), F.col(f"n{i}")) for i, (c, p) in enumerate(pairs)]
    return counts.select(inline_rows(("coluna", "padrao", "registros"), rows)).where("registros > 0")


def pattern_examples(df: DataFrame, columns: Sequence[str], patterns: Sequence[str], n: int = 5) -> DataFrame:
    """The first n distinct values, in order, of each (column, text pattern)."""
    long = df.select(inline_rows(("coluna", "valor"), [(F.lit(c), F.col(c).cast("string")) for c in columns])).distinct()
    found = long.withColumn("padrao", F.explode(F.array(*[F.lit(p) for p in patterns]))).where(F.contains(F.lower("valor"), F.lower("padrao")))
    order = F.row_number().over(Window.partitionBy("coluna", "padrao").orderBy("valor"))
    return found.withColumn("nth", order).where(F.col("nth") <= n).select("coluna", "padrao", F.col("nth").alias("ordem"), "valor")


def year_census(df: DataFrame, columns: Sequence[str], year: int) -> DataFrame:
    """Rows per column whose text holds the year."""
    return pattern_census(df, columns, [str(year)]).select("coluna", "registros")


def year_value_census(df: DataFrame, column: str, year: int, top: int = 5) -> DataFrame:
    """Most frequent values of a column among those holding the year."""
    text = F.col(column).cast("string")
    return (
        df.where(contains_text(text, str(year)))
        .groupBy(text.alias("valor")).agg(F.count(F.lit(1)).alias("registros"))
        .orderBy(F.desc("registros"), "valor").limit(top)
    )


def filter_year_or_fallback(df: DataFrame, wanted: int, fallback: int, dates: str | None = None) -> DataFrame:
    """The wanted year when it has rows, else the fallback year. dates: as in filter_year."""
    either = df.where(date_bounds(dates, wanted * 100 + 1, wanted * 100 + 12) | date_bounds(dates, fallback * 100 + 1, fallback * 100 + 12))
    present = filter_year(df, wanted, dates).agg(F.max("ano").alias("ano")).scalar()
    return either.where(F.col("ano").isin(wanted, fallback) & (F.col("ano") == F.coalesce(present, F.lit(fallback))))
