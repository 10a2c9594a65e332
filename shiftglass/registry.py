"""Name -> query and name -> SQL of the reference's own operators on the driver's tables."""

from __future__ import annotations

from .plans import lists, live, reports, rollups, scenes, sessions

MODULES = (rollups, reports, lists, scenes, live, sessions)

QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
