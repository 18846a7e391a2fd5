"""The registered queries: each operator over stand-in tables, with the SQL that must give the same rows."""

from __future__ import annotations

from meridian.queries import aggregates, entities, etl, filters, joins, lobbying, lookups, matching, plans, public, records, searches, windows  # noqa: F401
from meridian.queries.base import QUERIES, SQL  # noqa: F401
