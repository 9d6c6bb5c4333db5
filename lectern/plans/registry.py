"""All queries by name."""

from __future__ import annotations

from lectern.plans import catalog, intake, live, media, people, reading, talk
from lectern.plans.query import Query

MODULES = [catalog, reading, people, talk, media, intake, live]


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for name, query in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = query
    return found
