"""Turning one wide row into several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def inline_rows(names: Sequence[str], rows: Sequence[Sequence[Column]]) -> Column:
    """Generator of rows with the given column names, for use in a select."""
    return F.inline(F.array(*[F.struct(*[value.alias(name) for name, value in zip(names, row)]) for row in rows]))
