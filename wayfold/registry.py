"""All queries over the driver's tables, by name, with their SQL oracles."""

from __future__ import annotations

from wayfold.plans import builds, contract_queries, decision_queries, pool_queries, rollups, set_queries, store_queries, trajectories  # noqa: F401
from wayfold.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
