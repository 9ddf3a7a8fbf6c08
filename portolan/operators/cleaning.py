"""Cleaning: whole-table projections, decided where needed by one aggregate row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions import dates, numbers
from portolan.functions.shape import inline_rows
from portolan.functions.text import fold_name, normalize_text
from portolan.operators import roles

# Quantity headers parsed as Brazilian numbers.
NUMERIC_HEADERS = (
    "VOLUMES", "VOLUME (M³)", "PESO BRUTO", "QTDE CONTAINER", "QTDE CONTEINER", "QUANTIDADE TEUS", "C20", "C40",
    "QUANTIDADE C20", "QUANTIDADE C40", "TEUS", "QTDE FCL", "QTDE VEÍCULOS", "QUANTIDADE VEICULOS",
)

# Date headers whose format is detected.
DATE_HEADERS = ("DATA CONSULTA", "DATA DE EMBARQUE", "DATA EMBARQUE", "DATA_EXTRACAO", "ETA", "ETS", "SAÍDA PORTO")

# Period header.
PERIOD_HEADER = "ANO/MÊS"

# Operation labels and their codes.
OPERATION_LABELS = {"Importação": "importacao", "Exportação": "exportacao", "Cabotagem": "cabotagem"}

# Client headers per operation, in order of preference.
CLIENT_HEADERS = {
    "importacao": ("CONSIGNATARIO FINAL", "CONSIGNATÁRIO", "NOME IMPORTADOR", "IMPORTADOR", "CLIENTE"),
    "exportacao": ("NOME EXPORTADOR", "EXPORTADOR", "CLIENTE"),
    "cabotagem": ("CLIENTE", "DESTINATÁRIO", "REMETENTE"),
}


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def normalize_strings(df: DataFrame) -> DataFrame:
    """Normalise every string column in one projection."""
    texts = set(string_columns(df))
    return df.select(*[normalize_text(_quoted(c)).alias(c) if c in texts else _quoted(c) for c in df.columns])


def clean_quantities(df: DataFrame, headers: Sequence[str] = NUMERIC_HEADERS) -> DataFrame:
    """Parse the known quantity columns; columns that already hold numbers only lose their nulls."""
    texts = set(string_columns(df))

    def cleaned(c: str) -> Column:
        if c not in headers:
            return _quoted(c)
        value = numbers.parse_quantity(_quoted(c)) if c in texts else F.coalesce(_quoted(c).cast("double"), F.lit(0.0))
        return value.alias(c)

    return df.select(*[cleaned(c) for c in df.columns])


def numeric_or_digits(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers per column; a column without a single number keeps its digits and minus signs."""
    counts = df.agg(F.struct(*[F.count(numbers.to_number(_quoted(c))).alias(f"n{i}") for i, c in enumerate(columns)])).scalar()
    return df.withColumns({
        c: F.when(counts[f"n{i}"] > 0, numbers.to_number(_quoted(c))).otherwise(numbers.digits_and_minus(_quoted(c)))
        for i, c in enumerate(columns)
    })


def rescale_percentage(df: DataFrame, column: str = "probabilidade") -> DataFrame:
    """Divide by 100 when any value is above 1."""
    largest = df.agg(F.max(column)).scalar()
    return df.withColumn(column, F.when(largest > 1, F.col(column) / 100).otherwise(F.col(column)))


def count_from_sizes(c20: str = "qtd_c20", c40: str = "qtd_c40") -> Column:
    """Containers as 20' plus 40' boxes, each counted once."""
    return F.coalesce(numbers.to_number(c20), F.lit(0.0)) + F.coalesce(numbers.to_number(c40), F.lit(0.0))


def split_period(df: DataFrame, column: str = "ano_mes") -> DataFrame:
    period = numbers.to_number(column)
    return df.withColumns({column: period, "ano": dates.split_year(period), "mes": dates.split_month(period)})


def _failures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: per column and format, the distinct values the format does not parse.

    Dates repeat a lot, so values are made distinct before they are parsed.
    """
    values = df.select(inline_rows(("coluna", "valor"), [(F.lit(c), _quoted(c)) for c in columns]))
    distinct = values.where("valor is not null").distinct()
    flags = distinct.select("coluna", *[
        dates.parse_date("valor", fmt).isNull().alias(f"b{j}") for j, fmt in enumerate(dates.DATE_FORMATS)])
    return flags.agg(*[
        F.count_if((F.col("coluna") == c) & F.col(f"b{j}")).alias(f"f{i}_{j}")
        for i, c in enumerate(columns) for j in range(len(dates.DATE_FORMATS))
    ])


def _first_fitting(i: int, row: Column | None = None) -> Column:
    def failures(j: int) -> Column:
        return F.col(f"f{i}_{j}") if row is None else row[f"f{i}_{j}"]

    return F.coalesce(*[F.when(failures(j) == 0, F.lit(fmt)) for j, fmt in enumerate(dates.DATE_FORMATS)])


def detect_date_formats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First format that parses every value of each column, null when none does: one aggregate over the whole columns."""
    return _failures(df.select(*[_quoted(c) for c in columns]), columns).select(
        inline_rows(("coluna", "formato"), [(F.lit(c), _first_fitting(i)) for i, c in enumerate(columns)]))


def parse_dates(df: DataFrame, columns: Sequence[str] = DATE_HEADERS) -> DataFrame:
    """Parse date columns in their detected format (value by value, day first, when
    none fits all) and derive ``ano`` and ``mes`` from the period or the first of them.
    """
    found = [c for c in columns if c in df.columns]
    updates: dict[str, Column] = {}
    if found:
        failures = _failures(df, found)
        row = failures.select(F.struct(*failures.columns)).scalar()
        for i, c in enumerate(found):
            fitting = F.coalesce(*[
                F.when(row[f"f{i}_{j}"] == 0, dates.parse_date(_quoted(c), fmt)) for j, fmt in enumerate(dates.DATE_FORMATS)
            ])
            some = reduce(lambda a, b: a | b, [row[f"f{i}_{j}"] == 0 for j in range(len(dates.DATE_FORMATS))])
            updates[c] = F.when(some, fitting).otherwise(dates.parse_any_date(_quoted(c)))
    if PERIOD_HEADER in df.columns:
        updates[PERIOD_HEADER] = dates.parse_year_month(_quoted(PERIOD_HEADER))
    parsed = df.withColumns(updates)
    source = PERIOD_HEADER if PERIOD_HEADER in df.columns else (found[0] if found else None)
    if source:
        for name, part in (("ano", F.year), ("mes", F.month)):
            if name not in df.columns:
                parsed = parsed.withColumn(name, part(_quoted(source)))
    return parsed


def process_table(df: DataFrame) -> DataFrame:
    """Dates, texts and quantities of a raw movement table."""
    return clean_quantities(normalize_strings(parse_dates(df)))


def tidy(df: DataFrame) -> DataFrame:
    """Drop empty rows and unnamed columns, trim the headers."""
    kept = [c for c in df.columns if not c.startswith("Unnamed")]
    return df.dropna("all").select(*[_quoted(c).alias(c.strip()) for c in kept])


def auto_numeric(df: DataFrame) -> DataFrame:
    """Turn every text column with at least one number into numbers; the rest of such a column becomes null.

    The new schema depends on the data, so one aggregate row of counts is read here.
    """
    texts = string_columns(df)
    if not texts:
        return df
    counts = df.agg(*[F.count(numbers.to_number(_quoted(c))).alias(f"n{i}") for i, c in enumerate(texts)]).first()
    numeric = {c for i, c in enumerate(texts) if counts[f"n{i}"] > 0}
    return df.select(*[numbers.to_number(_quoted(c)).alias(c) if c in numeric else _quoted(c) for c in df.columns])


def first_quantity(columns: Sequence[str]) -> Column:
    """First column of a row that holds a number."""
    return F.coalesce(*[numbers.to_number(_quoted(c)) for c in columns])


def derive_year_month(df: DataFrame) -> DataFrame:
    """Year and month from their own columns (months limited to 1..12), else from the
    date column with most valid dates; adds ``ano_derivado``, ``mes_derivado`` and ``periodo``.
    """
    candidates = roles.columns_with(df.columns, ("data", "dt", "ano", "mes", "periodo"))
    combined = set(roles.columns_with(candidates, ("ano_mes", "ano/mes", "ano-mes", "mes/ano")))
    years = [c for c in roles.columns_with(candidates, ("ano",)) if c not in combined]
    months = [c for c in roles.columns_with(candidates, ("mes",)) if c not in combined]
    whole = [c for c in candidates if c not in years and c not in months]

    def month_of(c: str) -> Column:
        value = numbers.to_number(_quoted(c))
        return F.when(value.between(1, 12), value)

    def date_of(c: str) -> Column:
        text = _quoted(c).cast("string")
        return F.coalesce(dates.parse_any_date(text), dates.parse_period(text))

    measures = [F.count(numbers.to_number(_quoted(c))).alias(f"y{i}") for i, c in enumerate(years)]
    measures += [F.count(month_of(c)).alias(f"m{i}") for i, c in enumerate(months)]
    measures += [F.count(date_of(c)).alias(f"d{i}") for i, c in enumerate(whole)]
    if not measures:
        return df
    counts = df.agg(*measures)
    row = counts.select(F.struct(*counts.columns)).scalar()

    date = F.lit(None).cast("date")
    for i, c in reversed(list(enumerate(whole))):
        better = F.greatest(F.lit(-1), *[row[f"d{j}"] for j in range(len(whole)) if j != i])
        first = F.lit(True)
        for j in range(i):
            first = first & (row[f"d{j}"] < row[f"d{i}"])
        date = F.when((row[f"d{i}"] >= better) & first, date_of(c)).otherwise(date)

    def pick(names: Sequence[str], mark: str, value, fallback: Column) -> Column:
        result = fallback
        for i, c in reversed(list(enumerate(names))):
            result = F.when(row[f"{mark}{i}"] > 0, value(c).cast("int")).otherwise(result)
        return result

    year = pick(years, "y", lambda c: numbers.to_number(_quoted(c)), F.year(date))
    month = pick(months, "m", month_of, F.month(date))
    return df.withColumns({
        "ano_derivado": year, "mes_derivado": month,
        "periodo": F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0")),
    })


def canonical_period(columns: Sequence[str], date_column: str | None = None) -> Column:
    """yyyy-MM from a year-month column, else year and month columns, else the date column."""
    combined = roles.columns_with(columns, ("ano_mes", "ano/mes", "ano-mes", "mes/ano"))
    options = [dates.month_label(dates.parse_period(_quoted(c))) for c in combined]
    year = next((c for c in columns if fold_name(c) == "ano"), None)
    month = next((c for c in columns if fold_name(c) == "mes"), None)
    if year and month:
        parts = [F.lpad(_quoted(year).cast("string"), 4, "0"), F.lpad(_quoted(month).cast("string"), 2, "0")]
        options.append(F.when(_quoted(year).isNotNull() & _quoted(month).isNotNull(), F.concat_ws("-", *parts)))
    if date_column:
        options.append(dates.month_label(dates.parse_any_date(_quoted(date_column).cast("string"))))
    return F.coalesce(*options) if options else F.lit(None).cast("string")


def map_values(c: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Replace labels by their codes; others become the default (null when none is given)."""
    result = F.lit(default).cast("string")
    for label, code in mapping.items():
        result = F.when(c == label, code).otherwise(result)
    return result


def client_of(columns: Sequence[str], operation: Column, headers: Mapping[str, Sequence[str]] = CLIENT_HEADERS) -> Column:
    """First filled client column in the order that fits the row's operation."""
    result = F.lit(None).cast("string")
    for code, names in headers.items():
        found = [_quoted(c) for c in names if c in columns]
        if found:
            result = F.when(operation == code, F.coalesce(*found)).otherwise(result)
    return result


def rename_canonical(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Rename aliased headers; several headers of one role become their first filled value."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(aliases.get(c.upper(), c), []).append(c)
    return df.select(*[
        (F.coalesce(*[_quoted(c) for c in names]) if len(names) > 1 else _quoted(names[0])).alias(target)
        for target, names in groups.items()
    ])
