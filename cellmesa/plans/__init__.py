"""Registered queries and the SQL that states their results."""

from . import de_queries, graph_queries, prep_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "de_queries", "graph_queries", "prep_queries"]
