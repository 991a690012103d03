"""Registered queries of the core, with the SQL that checks them where SQL can."""

from __future__ import annotations

from . import problems, q_graph, q_relational, q_solve, q_sources  # noqa: F401
from .registry import QUERIES as _MORE, SQL as _SQL

QUERIES: dict = {**problems.QUERIES, **_MORE}
SQL: dict = {**problems.SQL, **_SQL}
