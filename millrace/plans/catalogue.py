"""Every query by name, and the SQL that states the same."""

from millrace.plans import cluster_queries, graph_queries, itemset_queries, recommend_queries, review_queries, source_queries  # noqa: F401  they register themselves
from millrace.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
