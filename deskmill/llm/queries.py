"""All queries of this subpackage; importing registers them."""

from deskmill.llm import queries_docs, queries_pages, queries_vectors  # noqa: F401
from deskmill.llm.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
