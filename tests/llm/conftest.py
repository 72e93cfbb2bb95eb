from __future__ import annotations

import pytest


@pytest.fixture
def table(spark, folder):
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
