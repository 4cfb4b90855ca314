"""All queries of the library, gathered."""

from __future__ import annotations

from . import queries, queries_discovery, queries_evaluation, queries_io

REGISTRY = queries.REGISTRY
__all__ = ["REGISTRY", "queries_discovery", "queries_evaluation", "queries_io"]
