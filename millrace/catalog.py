"""All queries of the engine and their SQL."""

from millrace.plans import causal, decisions, detection, diagnosis, economy, ingestion, learning, marts, matching, operations, prediction, relational, serving, views, windows  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
