"""All queries of the library and their SQL."""

from __future__ import annotations

from fluvia.plans import graphs, nexmark, texts  # noqa: F401  each adds its own
from fluvia.plans.catalogue import QUERIES, SQL
from fluvia.streaming import queries as streams  # noqa: F401

__all__ = ["QUERIES", "SQL"]
