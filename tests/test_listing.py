"""Pages of a listing by ranges against sorted rows, and the ranges a page reads."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from paperloom.operators.listing import Listing

SCHEMA = "id long, created_at timestamp_ntz, kind string, text string"


def rows_of(n: int):
    """A third of the rows has one time, some have none."""
    rng = random.Random(5)
    hot = datetime(2024, 1, 1)
    time = lambda: rng.choice([hot, hot + timedelta(minutes=rng.randint(-50, 50)), hot + timedelta(days=rng.randint(-9, 9))])
    return [(i, None if i % 50 == 0 else time(), rng.choice(["a", "a", "b", None]), f"t{i}") for i in range(n)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is None, -(r[1] or datetime(1970, 1, 1)).timestamp(), r[0]))


def listing(spark, path, rows, ranges):
    df = spark.createDataFrame(rows, SCHEMA)
    found = Listing(spark, str(path), df.schema, "created_at", "id", ("kind",))
    found.write(df, ranges)
    return found


def test_every_page_is_that_of_the_sorted_rows(spark, tmp_path):
    rows = rows_of(400)
    found = listing(spark, tmp_path / "l", rows, 8)
    for kind in (None, "a", "b", "none such"):
        want = in_order([r for r in rows if kind is None or r[2] == kind])
        for limit, offset in ((1, 0), (30, 0), (30, 77), (150, 40), (30, len(want) - 5), (10, len(want)), (1000, 0)):
            if offset < 0:
                continue
            got = [tuple(r) for r in found.page(limit, offset, kind=kind).collect()]
            assert got == [(*r, len(want)) for r in want[offset : offset + limit]], (kind, limit, offset)


def test_a_page_reads_the_ranges_it_lies_in(spark, tmp_path):
    rows = rows_of(400)
    found = listing(spark, tmp_path / "l", rows, 8)
    counts = {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "l/counts")).groupBy("listing_range").sum("n").collect()}
    assert len(counts) == 8 and max(counts.values()) < 2.5 * 400 / 8
    want = in_order(rows)
    # all ranges but those of the page hold garbage
    offset, limit = 200, 10
    ends, at = {}, 0
    for part in sorted(counts):
        ends[part] = (at, at + counts[part])
        at += counts[part]
    needed = {p for p, (a, b) in ends.items() if a < offset + limit and b > offset}
    assert len(needed) <= 2
    for part in set(counts) - needed:
        for name in Path(tmp_path, f"l/rows/listing_range={part}").glob("*.parquet"):
            name.write_bytes(b"not to be read")
    assert [r[0] for r in found.page(limit, offset).collect()] == [r[0] for r in want[offset : offset + limit]]


def test_empty_listing_and_bad_arguments(spark, tmp_path):
    found = listing(spark, tmp_path / "l", [], 4)
    assert found.page(10).collect() == []
    for bad in (lambda: found.page(0), lambda: found.page(5, -1), lambda: found.page(5, text="t1")):
        with pytest.raises(ValueError):
            bad()
