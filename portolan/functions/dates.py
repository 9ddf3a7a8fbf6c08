"""Date and period functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats tried in this order (day first before month first).
DATE_FORMATS = ("d/M/yyyy", "yyyy-M-d", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "yyyy/M")

# How a text in each format becomes an ISO date. A cast reports an invalid date
# as null at no cost, while a formatter throws for every value that does not fit.
_DAY, _YEAR = "([0-9]{1,2})", "([0-9]{4})"
_SHAPES = {
    "d/M/yyyy": (f"^{_DAY}/{_DAY}/{_YEAR}$", "$3-$2-$1"),
    "yyyy-M-d": (f"^{_YEAR}-{_DAY}-{_DAY}$", "$1-$2-$3"),
    "M/d/yyyy": (f"^{_DAY}/{_DAY}/{_YEAR}$", "$3-$1-$2"),
    "yyyy/M/d": (f"^{_YEAR}/{_DAY}/{_DAY}$", "$1-$2-$3"),
    "d-M-yyyy": (f"^{_DAY}-{_DAY}-{_YEAR}$", "$3-$2-$1"),
    "yyyy/M": (f"^{_YEAR}/{_DAY}$", "$1-$2-01"),
    "yyyyMM": ("^([0-9]{4})([0-9]{2})$", "$1-$2-01"),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: Column | str, fmt: str) -> Column:
    """Strict parse in one of the known formats; null when it does not fit."""
    shape, iso = _SHAPES[fmt]
    text = _col(c)
    return F.when(text.rlike(shape), F.regexp_replace(text, shape, iso)).try_cast("date")


def parse_any_date(c: Column | str) -> Column:
    """First of the known formats that fits this value."""
    return F.coalesce(*[parse_date(c, fmt) for fmt in DATE_FORMATS])


def parse_year_month(c: Column | str) -> Column:
    """First day of a yyyyMM period, given as a number or text."""
    return parse_date(F.lpad(_col(c).cast("string"), 6, "0"), "yyyyMM")


def parse_period(c: Column | str) -> Column:
    """First day of a month written as yyyyMM, yyyy-MM, yyyy/MM, MM/yyyy or MM-yyyy."""
    text = F.trim(_col(c).cast("string"))
    year_first = F.regexp_replace(text, r"^([0-9]{4})[-/]?([0-9]{2})$", "$1-$2-01")
    month_first = F.regexp_replace(text, r"^([0-9]{2})[-/]([0-9]{4})$", "$2-$1-01")
    return F.coalesce(*[F.when(iso != text, iso).try_cast("date") for iso in (year_first, month_first)])


def year_month(date: Column | str) -> Column:
    """yyyyMM as INT."""
    d = _col(date)
    return (F.year(d) * 100 + F.month(d)).cast("int")


def split_year(ano_mes: Column | str) -> Column:
    return F.floor(_col(ano_mes) / 100).cast("int")


def split_month(ano_mes: Column | str) -> Column:
    return (_col(ano_mes) % 100).cast("int")


def month_label(date: Column | str) -> Column:
    return F.date_format(_col(date), "yyyy-MM")


def months_between_starts(first: Column, last: Column) -> Column:
    """Length in months counted as days / 30."""
    return F.datediff(last, first) / F.lit(30.0)
