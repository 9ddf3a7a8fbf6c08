"""All composed queries, by area."""

from portolan.plans.catalog import (  # noqa: F401
    cleaning,
    files,
    filters,
    measures,
    quality,
    questions,
    rankings,
    scalars,
    stored,
    texts,
    tracking,
    trends,
)
from portolan.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
