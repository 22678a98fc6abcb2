"""All queries of the reference operators and their oracle SQL."""

from __future__ import annotations

from vitrine.plans import catalog_plans, file_plans, ranking_plans, session_plans  # noqa: F401  they register their queries
from vitrine.plans.base import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "search"
