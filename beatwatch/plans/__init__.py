"""Jobs that put the operators together, and the registry of queries on the given tables."""

from __future__ import annotations


def all_entries() -> dict:
    """Every registered query by name."""
    from beatwatch.plans import batch_queries, ingest_queries, serving_queries, stream_queries  # noqa: F401
    from beatwatch.plans.registry import ENTRIES

    return ENTRIES
