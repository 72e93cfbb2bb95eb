"""Every registered query against its SQL."""

from __future__ import annotations

import pytest
from compare import compare, connect

from paperloom.plans.catalogue import checking_sql, spark_queries

# Rows-only: the files themselves are compared in test_documents.
WITHOUT_SQL = {"scan_files"}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_other_query_has_sql():
    assert set(spark_queries()) - set(checking_sql()) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(spark_queries()))
def test_query(spark, con, folder, name):
    outcome = compare(spark, con, folder, name)
    assert outcome.startswith("rows " if name in WITHOUT_SQL else "same"), outcome
    assert "TYPES" not in outcome, outcome
