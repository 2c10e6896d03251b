"""Importing this package registers every plan."""

from plumbline.plans import aggregates, audits, keys, lookups, questions, ranking, retrieval, sessions, text, validation  # noqa: F401
from plumbline.plans.registry import PLANS, oracle_queries, spark_queries

__all__ = ["PLANS", "oracle_queries", "spark_queries"]
