"""All corpus queries."""

from portolan.llm import q_filtering, q_models, q_private, q_tables  # noqa: F401
from portolan.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
