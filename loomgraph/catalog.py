"""All queries of the engine and their checking SQL, gathered from the plan modules."""

from __future__ import annotations

from loomgraph.plans import composed, extraction, graphs, operations, search, sources, views

MODULES = (search, graphs, extraction, composed, sources, operations, views)


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
