"""All registered queries of the library itself and their SQL."""

from __future__ import annotations

from varigrid.plans import globe_queries, pixel_queries, window_queries  # noqa: F401
from varigrid.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
