"""All queries over the reference's own operators."""

from __future__ import annotations

from factloom.plans import artifact_queries, audit_queries, check_queries, context_queries, grade_queries, payload_queries, shapes, stream_queries, structured_queries, template_queries  # noqa: F401  (they register their queries)
from factloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
