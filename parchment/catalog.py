"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from parchment.plans.oracles import ORACLES
from parchment.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
