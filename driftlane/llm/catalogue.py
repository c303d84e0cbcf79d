"""All queries of this subpackage."""

from driftlane.llm import layout_queries, model_queries, text_queries  # noqa: F401
from driftlane.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
