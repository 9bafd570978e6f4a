"""Queries of the engine's own operators, from all modules that register some."""

from tideglass.plans import events_queries, feature_queries, kernel_queries, market_queries, model_queries, null_queries, panel_queries, source_queries, stats_queries, stream_queries, universe_queries  # noqa: F401
from tideglass.plans.registry import ORACLE, QUERIES  # noqa: F401
