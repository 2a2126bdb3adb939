"""All queries over the driver's tables by name, and the SQL that must give the same rows."""

from __future__ import annotations

from . import briefing, computed, dates, gates, graphs, increments, inventory, orders, queue, rules, scan, shapes, sources, text  # noqa: F401
from .tables import ORACLES, QUERIES

FLAGSHIP = scan.flagship

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
