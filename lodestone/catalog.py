"""Every query of the engine by name, with the SQL it is checked against."""

from __future__ import annotations

from lodestone.queries import aggregates, changes, code, events, graphs, learned, more, registry, store, streams, text, vectors  # noqa: F401  (they register)
from lodestone.queries.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
