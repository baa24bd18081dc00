"""Queries of this subpackage and the SQL that checks those SQL can express."""

from __future__ import annotations

from thermalis.llm import queries as q

QUERIES = {name: f for name, f in vars(q).items() if name.startswith("op")}
ORACLE_SQL = q.ORACLE_SQL
