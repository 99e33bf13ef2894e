"""All registered queries."""

from __future__ import annotations

from lucidex.plans import catalog_changes, catalog_content, catalog_sites  # noqa: F401
from lucidex.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
