"""Every registered query of the traffic engine, with its SQL."""

from __future__ import annotations

from . import edge_queries, fleet_queries, live_queries, prepare_queries, request_queries, result_queries, schedule_queries, store_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
