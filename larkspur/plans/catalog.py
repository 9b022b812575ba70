"""All queries of the library: importing the plan modules registers them."""

from __future__ import annotations

from larkspur.plans import basics, exchange, measures, ordered, relational, scalars, semistructured, streams, surface  # noqa: F401
from larkspur.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
