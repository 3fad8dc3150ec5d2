"""All queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from .plans import counterfactual_queries, feature_queries, model_queries  # noqa: F401  they register themselves
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
