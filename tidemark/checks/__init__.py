"""Registered queries over the given tables, each next to its SQL counterpart."""

from __future__ import annotations

from importlib import import_module

TOPICS = ("activity", "expressions", "repository", "profiling", "loading", "relations", "texts")


def load() -> tuple[dict, dict]:
    """All queries and their SQL, by name."""
    from tidemark.checks import registry

    for topic in TOPICS:
        import_module(f"tidemark.checks.{topic}")
    return registry.QUERIES, registry.SQL
