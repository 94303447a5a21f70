"""All registered queries."""

from __future__ import annotations

from cohortlens.plans import cohort_queries, screen_queries, vector_queries  # noqa: F401  (each module registers its queries)
from cohortlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
