"""All queries of the library proper, with their SQL."""

from __future__ import annotations

from . import catalog, evidence, features, files, frames, govern, match, pool, replays, roster, rules, search

PARTS = [search, evidence, govern, catalog, match, pool, frames, roster, files, rules, features, replays]
QUERIES: dict = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
