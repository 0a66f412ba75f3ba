"""All queries on the reference's operators by name, with their SQL."""

from __future__ import annotations

from labelloom.plans import corrections, facts, flows, joins, labels, local, located, named

PARTS = (facts, labels, joins, located, named, local, corrections, flows)
QUERIES: dict = {k: f for part in PARTS for k, f in part.QUERIES.items()}
SQL: dict = {k: s for part in PARTS for k, s in part.SQL.items()}
