"""All registered queries: importing this module fills the registry."""

from tickloom.plans import (  # noqa: F401
    analytics_queries,
    audit_queries,
    event_queries,
    file_queries,
    limit_queries,
    stream_queries,
)
from tickloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
