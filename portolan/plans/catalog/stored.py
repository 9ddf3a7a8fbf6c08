"""Queries over the stored star: the same results as from the folder, without a shuffle under the join."""

from __future__ import annotations

import uuid

from portolan.plans import star
from portolan.plans.catalog import filters, texts, trends
from portolan.plans.registry import ORACLES, query
from portolan.session import work_folder

BUCKETS = 16
_STARS: dict[tuple[str, str], str] = {}


def stored_star(spark, d):
    """One star per session and folder; its buckets grow in number with the lines."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STARS:
        _STARS[key] = star.store(spark, d, work_folder(spark, "star"), f"star_{uuid.uuid4().hex[:12]}", star.buckets_for(spark, d, BUCKETS))
    return _STARS[key]


@query("j7_star_movements", ORACLES["j7_movements"])
def star_movements(spark, d):
    return filters.movement_view(spark, stored_star(spark, d))


@query("k5_star_carriers_at_port", ORACLES["k5_carriers_at_port"])
def star_carriers(spark, d):
    return filters.carriers_at_port(spark, stored_star(spark, d))


@query("a6_star_budget_vs_actual", ORACLES["a6_budget_vs_actual"])
def star_budget(spark, d):
    return trends.budget_vs_actual(spark, stored_star(spark, d))


@query("x18_star_brief", ORACLES["x18_brief"])
def star_brief(spark, d):
    return texts.table_brief(spark, stored_star(spark, d))
