"""Where composed queries and their SQL twins are recorded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from portolan.plans.movements import MOVEMENTS_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Record a query; in its SQL, ``@m`` stands for the movement view."""

    def record(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is already recorded")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.replace("@m", MOVEMENTS_SQL).strip()
        return function

    return record
