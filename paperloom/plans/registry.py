"""Registry of queries and their checking SQL.

A query is a function of a :class:`Source`. Its SQL may name any input view, base table or shared common table
expression; those it uses are put in front of it in dependency order.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from paperloom.sources.views import Source, duckdb_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Source], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
SHARED_SQL: dict[str, str] = duckdb_views()


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, sql)
        return build

    return register


def shared_sql(name: str, body: str) -> None:
    """Make ``name`` available to every checking SQL; ``name(cols)`` declares the columns of a recursive one."""
    SHARED_SQL[name] = body


def _add_needed(sql: str, done: list[str]) -> None:
    """Append the heads that ``sql`` uses to ``done``, each after those it uses itself."""
    used = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", sql))
    for head, body in SHARED_SQL.items():
        name = head.split("(")[0]
        if name in used and head not in done:
            # a recursive body names itself, which must not be followed
            _add_needed(re.sub(rf"\b{name}\b", "", body), done)
            done.append(head)


def full_sql(sql: str) -> str:
    heads: list[str] = []
    _add_needed(sql, heads)
    if not heads:
        return sql.strip()
    parts = [f"{head} AS ({SHARED_SQL[head].strip()})" for head in heads]
    own = re.sub(r"^WITH(\s+RECURSIVE)?\s", ",\n", sql.strip())
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + own
