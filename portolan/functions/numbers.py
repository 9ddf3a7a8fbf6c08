"""Number functions: lenient parsing, guarded arithmetic and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Double, or null where the value is not a number."""
    return _col(c).try_cast("double")


def parse_quantity(c: Column | str) -> Column:
    """Brazilian quantity text as a double: dots group thousands, the comma is the
    decimal mark, signs and other characters are dropped, nothing usable gives 0.
    """
    marks = F.translate(F.trim(_col(c)), ",.", ".")
    # In one pass: other characters, and dots before the last one.
    last_dot_only = F.regexp_replace(marks, r"[^0-9.]|\.(?=[^.]*\.)", "")
    return F.coalesce(last_dot_only.try_cast("double"), F.lit(0.0))


def decimal_comma(c: Column | str) -> Column:
    """Double with a comma accepted as decimal mark; invalid gives null."""
    return F.replace(_col(c).cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def parse_revenue(c: Column | str) -> Column:
    """Revenue text: keep digits and both marks, then read the comma as a dot.
    A value using both marks is not a number here and becomes null.
    """
    kept = F.regexp_replace(_col(c).cast("string"), r"[^0-9.,]", "")
    return F.replace(kept, F.lit(","), F.lit(".")).try_cast("double")


def digits_and_minus(c: Column | str) -> Column:
    return F.regexp_replace(_col(c).cast("string"), r"[^0-9-]", "").try_cast("double")


def truncate(c: Column | str) -> Column:
    """Toward zero, as BIGINT."""
    return _col(c).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """part / whole in percent, 0 when the whole is 0 or null."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def percent_change(new: Column, old: Column) -> Column:
    """Change from old to new in percent; null when old is 0 or null."""
    return F.try_divide((new - old) * F.lit(100.0), old)


def format_thousands(c: Column | str) -> Column:
    """Whole number with dots between thousands."""
    return F.replace(F.format_number(_col(c).cast("bigint"), 0), F.lit(","), F.lit("."))


def format_fixed(c: Column | str, digits: int = 2) -> Column:
    """Fixed-point text of a double, rounded half to even on its exact binary value.

    The fraction is scaled to a whole number of 2**-52, where the rounding is exact.
    """
    x = _col(c).cast("double")
    whole = F.floor(F.abs(x))
    scale, unit = 10**digits, 2**52
    parts = ((F.abs(x) - whole) * F.lit(float(unit))).cast("bigint") * F.lit(scale)
    down = F.shiftright(parts, 52)
    rest = parts.bitwiseAND(F.lit(unit - 1))
    floored = whole * F.lit(scale) + down
    up = (rest > unit // 2) | ((rest == unit // 2) & (floored % 2 == 1))
    cents = floored + F.when(up, 1).otherwise(0)
    units = ((cents - cents % F.lit(scale)) / F.lit(scale)).cast("bigint").cast("string")
    sign = F.when((x < 0) & (cents > 0), "-").otherwise("")
    if digits == 0:
        return F.concat(sign, units)
    return F.concat(sign, units, F.lit("."), F.lpad((cents % F.lit(scale)).cast("string"), digits, "0"))


def similarity(distance: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + _col(distance))


def confidence_band(r2: Column | str) -> Column:
    r = _col(r2)
    return F.when(r > 0.8, "Alta").when(r > 0.6, "Média").otherwise("Baixa")


def precision_band(r2: Column | str) -> Column:
    r = _col(r2)
    return F.when(r > 0.7, "Alta").when(r > 0.4, "Média").otherwise("Baixa")
