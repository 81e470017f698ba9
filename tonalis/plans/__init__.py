"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from tonalis.plans.registry import Registry


def all_registries() -> list[Registry]:
    """The registries of this package, in the order of their modules."""
    from tonalis.plans import dedupe, features, filling, intents, interface, library, listening, planner, quality, resolve, search, smartlists, sources, streams, sync, text

    return [m.query for m in (dedupe, features, filling, intents, interface, library, listening, planner, quality, resolve, search, smartlists, sources, streams, sync, text)]
