"""All registered queries; importing a family registers it."""

from lexloom.plans import store_queries, token_queries, vector_queries  # noqa: F401
from lexloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
