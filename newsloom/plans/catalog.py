"""All queries of the engine's own operators, by name, and the SQL that checks them."""

from __future__ import annotations

from . import archive, feed, metrics, pieces, reviews, state  # noqa: F401 - they register their queries
from .registry import QUERIES, SQL

FLAGSHIP = "proj03_search_entries"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
