"""All registered queries of the core library."""

from __future__ import annotations

from strandline.plans import bulletins, feed, fusion, intel, lookups, reconcile, state

MODULES = (feed, fusion, intel, lookups, reconcile, state, bulletins)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
