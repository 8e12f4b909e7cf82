"""All registered queries."""

from __future__ import annotations

from plumbline.plans import check_queries, history_queries, profile_queries, run_queries, scans, stream_queries, triage_queries
from plumbline.plans.registry import ORACLES, QUERIES

MODULES = (scans, check_queries, run_queries, profile_queries, history_queries, triage_queries, stream_queries)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
