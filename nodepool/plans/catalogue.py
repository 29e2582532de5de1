"""Queries of the engine by name, and the SQL each is compared with."""

from __future__ import annotations

from . import documents, edges, lifecycle, sessions

_PARTS = (documents, lifecycle, edges, sessions)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
