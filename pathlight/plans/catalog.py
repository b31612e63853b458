"""All registered queries of the engine."""

from __future__ import annotations

from . import card_queries, detector_queries, explorer_queries, function_queries, graph_queries, metric_queries, native_queries, reference_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
