"""All queries of the library by name, and the SQL that must return the same rows."""

from __future__ import annotations

from . import dashboard, decide, estimate, extras, guards, ingest, match, ordered, raster, simulate, streams
from .base import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _part in (ingest, ordered, raster, match, decide, estimate, simulate, streams, extras, guards, dashboard):
    QUERIES |= _part.plans.queries
    ORACLES |= _part.plans.oracles
