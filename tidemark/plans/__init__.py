"""Queries bound to the test tables."""

from tidemark.plans import backtest_queries, classify_queries, compare_queries, coverage_queries, evidence_queries, identity_queries, kernel_queries, metric_queries, read_queries, relational_queries, resolve_queries, route_queries, stream_queries, uncertainty_queries, version_queries  # noqa: F401
from tidemark.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
