"""Named queries over the test tables; importing this package registers all of them."""

from importlib import import_module

from deskmill.plans.registry import CHECK_SQL, QUERIES

for _area in ("journal", "sessions", "access", "text", "corpus", "search", "code", "privacy", "metadata", "evaluation", "streams"):
    import_module(f"deskmill.plans.{_area}")

__all__ = ["CHECK_SQL", "QUERIES"]
