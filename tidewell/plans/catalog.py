"""All queries of the engine."""

from tidewell.plans import audit, display, inference, learning, measures, policies, references, scoring, signals, statistics, streams, truth  # noqa: F401  each module registers its queries
from tidewell.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
