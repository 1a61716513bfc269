"""The registered queries and their SQL oracles, gathered from the query modules."""

from __future__ import annotations

from civilake.plans import changesets, elections, extraction, feeds, hydration, lifecycles, merges, pages, polls, recency, relational, reports, retrieval, scalars, streams

MODULES = (feeds, relational, polls, recency, merges, scalars, retrieval, elections, lifecycles, hydration, reports, extraction, changesets, streams, pages)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
