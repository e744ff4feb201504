"""Registered queries: each operator over the given tables, with the same result in SQL where SQL can say it."""

from terralog.plans import (  # noqa: F401
    geo_queries,
    log_queries,
    mesh_queries,
    point_queries,
    source_queries,
    stream_queries,
    telemetry_queries,
)
from terralog.plans.registry import oracles, registered

__all__ = ["oracles", "registered"]
