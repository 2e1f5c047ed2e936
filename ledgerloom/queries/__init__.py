"""All registered queries of the ledger engine."""

from __future__ import annotations

from . import detection, ledger, perimeter, reads, records, safety, statements, stored, support, tools, trust  # noqa: F401  (each registers its queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
