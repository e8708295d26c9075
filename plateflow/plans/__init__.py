"""Queries over the test tables, one module per subject."""

from plateflow.plans import badges, boxes, evaluation, gallery, quality, reads, results, scene, streams  # noqa: F401
from plateflow.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
