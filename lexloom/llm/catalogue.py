"""All queries of this subpackage; importing a family registers it."""

from lexloom.llm import (  # noqa: F401
    chat_queries,
    corpus_queries,
    dedup_queries,
    embedding_queries,
    model_queries,
    packing_queries,
    search_queries,
)
from lexloom.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
