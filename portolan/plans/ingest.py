"""One ingestion job: rename, check, convert, hold against the integrity rules, write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions import dates, numbers
from portolan.operators import cleaning, profile
from portolan.session import work_folder
from portolan.sources import sinks

REQUIRED = profile.KEY_COLUMNS


def convert(raw: DataFrame, aliases: Mapping[str, str], date: str, quantities: Sequence[str] = ("qtd_container",)) -> DataFrame:
    """A raw text table with canonical headers, texts, dates, quantities and the year and month as a number."""
    table = cleaning.rename_canonical(cleaning.tidy(raw), aliases)
    missing = [c for c in (date, *quantities) if c not in table.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    values = {c: numbers.parse_quantity(F.col(c)) for c in quantities}
    day = dates.parse_any_date(F.col(date))
    table = table.withColumns(values | {date: day})
    return cleaning.normalize_strings(table).withColumn("ano_mes", dates.year_month(date))


def ingest(raw: DataFrame, aliases: Mapping[str, str], date: str, folder: str, schema: str, required: Sequence[str] = REQUIRED, batch: str | None = None) -> DataFrame:
    """Convert a raw table and add it to the processed set; gives its integrity row.

    Under a batch id the job can run again: its rows are then in the set once. Without one they are appended.
    Rows are converted once, into a work folder: the filter, the set and the integrity row all read them there.

    A table that lacks a required column is turned away before anything is written. Rows without a
    month cannot be filed and are counted as nulls of ``ano_mes``.
    """
    table = convert(raw, aliases, date)
    missing = [c for c in required if c not in table.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    spark, converted = raw.sparkSession, work_folder(raw.sparkSession, "ingest")
    table.write.parquet(converted)
    table = spark.read.schema(table.schema).parquet(converted)
    sinks.write_processed(table.where(F.col("ano_mes").isNotNull()), folder, schema, batch=batch)
    return profile.integrity(table, required)
