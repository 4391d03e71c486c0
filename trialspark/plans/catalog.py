"""All queries over the reference's operators, by name, with the SQL that checks them."""

from __future__ import annotations

from trialspark.plans import audit_queries, merge_queries, prep_queries, sequence_queries, subject_queries, twosample_queries  # noqa: F401
from trialspark.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
