"""All registered queries and their SQL."""

from __future__ import annotations

from helixframe.catalog import model_queries, oracles, registry, sequence_queries, table_queries  # noqa: F401
from helixframe.catalog.base import QUERIES

ORACLES = oracles.ORACLES | sequence_queries.ORACLES | table_queries.ORACLES | model_queries.ORACLES

__all__ = ["ORACLES", "QUERIES"]
