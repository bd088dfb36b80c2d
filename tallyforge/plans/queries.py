"""All queries of the library, by name."""

from __future__ import annotations

from tallyforge.plans import assembly_queries, evidence_queries, geometry_queries, matching_queries, outline_queries, pricing_queries, ranking_queries, source_queries, takeoff_queries, text_queries
from tallyforge.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "assembly_queries", "evidence_queries", "geometry_queries", "matching_queries", "outline_queries", "pricing_queries", "ranking_queries", "source_queries", "takeoff_queries", "text_queries"]
