"""Imports every module that registers queries."""

from __future__ import annotations

from paperloom.plans import admission, answers, assembly, chunking, pages, parsing, reports, search, streams, validation  # noqa: F401
from paperloom.plans.registry import QUERIES, full_sql
from paperloom.sources.views import Source


def spark_queries():
    return {name: (lambda spark, folder, q=q: q.build(Source(spark, folder))) for name, q in QUERIES.items()}


def checking_sql() -> dict[str, str]:
    return {name: full_sql(q.sql) for name, q in QUERIES.items() if q.sql}
