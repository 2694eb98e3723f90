"""Every query of the engine by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from stratagraph.plans import change_queries, fact_queries, graph_queries, retrieval_queries, source_queries  # noqa: F401
from stratagraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
