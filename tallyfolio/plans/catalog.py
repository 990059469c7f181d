"""All registered queries and their SQL."""

from tallyfolio.plans import holding_queries, ingest_queries, more_queries, series_queries  # noqa: F401  (registers on import)
from tallyfolio.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
