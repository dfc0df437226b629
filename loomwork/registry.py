"""Named queries over the driver's tables and the same in SQL."""

from __future__ import annotations

from .plans import catalog_models, catalog_review  # noqa: F401  (they register their queries)
from .plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
