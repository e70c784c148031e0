"""All queries of the library with their SQL."""

from __future__ import annotations

from .queries import catalog, details, fuzzy, readers, scores, state, texts

_AREAS = (scores, catalog, texts, fuzzy, state, details, readers)
QUERIES: dict = {k: v for area in _AREAS for k, v in area.query.queries.items()}
ORACLE: dict[str, str] = {k: v for area in _AREAS for k, v in area.query.oracle.items()}
