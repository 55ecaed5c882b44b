"""Registered queries of the engine, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import audit_queries, recommend_queries, text_queries, url_queries, vector_queries
from .registry import ORACLES, QUERIES

flagship = vector_queries.similar_documents

__all__ = ["ORACLES", "QUERIES", "audit_queries", "flagship", "recommend_queries", "text_queries", "url_queries", "vector_queries"]
