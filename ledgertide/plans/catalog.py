"""Collects every query module into one catalog."""

from ledgertide.plans import (  # noqa: F401
    calendar_queries,
    event_queries,
    feed_queries,
    insider_queries,
    market_queries,
    people_queries,
    sector_queries,
    source_queries,
    stream_queries,
)
from ledgertide.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
