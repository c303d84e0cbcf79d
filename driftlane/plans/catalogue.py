"""All registered queries."""

from driftlane.plans import (  # noqa: F401
    drift_queries,
    file_queries,
    incident_queries,
    lifecycle_queries,
    model_queries,
    report_queries,
    stream_queries,
)
from driftlane.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
