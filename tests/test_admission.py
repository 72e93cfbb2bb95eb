from __future__ import annotations

import hashlib
from pathlib import Path
from random import Random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import sha256
from paperloom.functions.text import content_hash
from paperloom.operators import admission as A
from paperloom.plans.catalogue import spark_queries
from paperloom.sources import files
from paperloom.sources.files import format_table, route_format, scan_files
from paperloom.sources.tables import read_table, rewrite_partitions, write_tables


def uploads(spark, n=3000):
    """A third of all rows are copies of one content."""
    return spark.range(n).select(
        F.col("id").alias("arrival"),
        F.concat(F.lit("f"), "id", F.lit(".pdf")).alias("path"),
        F.lit("ELC").alias("discipline"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), F.col("id") % 700)).alias("file_hash"),
    )


def test_dedup_keeps_everything_and_is_idempotent(spark):
    incoming = uploads(spark)
    existing = spark.createDataFrame([("h1", 77, "Approved")], "file_hash string, id long, status string")
    new, repeats = A.dedup_by_hash(incoming, existing)
    assert new.count() + repeats.count() == incoming.count()
    assert new.where("file_hash = 'hot'").select("arrival").collect()[0][0] == 0
    assert {tuple(r) for r in repeats.where("file_hash = 'h1'").select("id", "status").distinct().collect()} == {(77, "Approved")}
    admitted = existing.unionByName(new.select("file_hash", F.col("arrival").alias("id"), F.lit("Checking").alias("status")))
    again, _ = A.dedup_by_hash(incoming, admitted)
    assert again.count() == 0


def test_plans_have_hash_aggregates(spark):
    new, repeats = A.dedup_by_hash(uploads(spark), spark.createDataFrame([("h1", 77, "Approved")], "file_hash string, id long, status string"))
    for df in (A.first_arrivals(uploads(spark)), new, repeats):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_heavy_hashes_meet_their_target_everywhere(spark):
    incoming, existing = uploads(spark), spark.createDataFrame([("h1", 77, "Approved"), ("h2", 5, "Checking")], "file_hash string, id long, status string")
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    some, rest = A.dedup_by_hash(incoming, existing, heavy_copies=100), A.dedup_by_hash(incoming, existing)
    assert [key(df) for df in some] == [key(df) for df in rest]
    # rows of the heavy hash are not shuffled on their way to their target
    heavy = [r for r in some[1].where("file_hash = 'hot'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert len(heavy) > 1


def test_first_of_rows_at_one_arrival(spark):
    rows = [(3, "b", "h"), (3, "a", "h"), (3, "a", "h"), (4, "a", "h"), (1, "x", None), (0, "y", None), (None, "z", "g")]
    df = spark.createDataFrame(rows, "arrival long, path string, file_hash string")
    assert sorted(map(str, A.first_arrivals(df).select("arrival", "path", "file_hash").collect())) == sorted(map(str, spark.createDataFrame([rows[1], rows[5], rows[6]], df.schema).collect()))


def test_reasons(spark):
    rows = spark.createDataFrame(
        [("a.exe", "XYZ"), ("a.pdf", "XYZ"), ("a.pdf", ""), ("a.pdf", None), ("a.PDF", "SIM")], "path string, discipline string"
    )
    accepted, refused = A.admit_uploads(rows)
    assert accepted.count() == 3
    assert [r.reason.split(":")[0] for r in refused.orderBy("path").collect()] == ["Unsupported file format", "Invalid discipline"]
    assert format_table(spark).count() == 11
    routed = {r.path: (r.extractor, r.reject_reason) for r in route_format(rows).collect()}
    assert routed["a.PDF"] == ("pdf", None) and routed["a.exe"][1].startswith("Unsupported file format: .exe")


def test_upsert_keeps_untouched_rows(spark):
    documents = spark.createDataFrame(
        [(1, "N1", "old", "Checking", "t0"), (2, "N2", "old", "Checking", "t0"), (3, None, "old", "Checking", "t0")],
        "id long, document_number string, title string, status string, created_at string",
    )
    results = spark.createDataFrame([(1, None, "new", True), (3, "N3", None, False)], "id long, document_number string, title string, success boolean")
    rows = {r.id: r for r in A.upsert_documents(documents, results, F.lit("t1"), "v1").collect()}
    assert (rows[1].document_number, rows[1].title, rows[1].status, rows[1].updated_at) == ("N1", "new", "Approved", "t1")
    assert (rows[2].title, rows[2].status, rows[2].model_version, rows[2].updated_at) == ("old", "Checking", None, "t0")
    assert (rows[3].document_number, rows[3].title, rows[3].status) == ("N3", "old", "Rejected")


def test_files_and_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    found = scan_files(spark, str(tmp_path / "in"))
    assert sorted(bytes(r.content) for r in found.collect()) == [b"a.pdf", b"b.pdf"]
    hashed = found.select("length", content_hash(F.col("content"))).collect()
    assert sorted(tuple(r) for r in hashed) == sorted((5, hashlib.sha256(x).hexdigest()) for x in (b"a.pdf", b"b.pdf"))
    documents = spark.createDataFrame([(1, "ELC"), (2, "MEC")], "id long, discipline string")
    write_tables({"documents": documents}, str(tmp_path / "t"))
    changed = spark.createDataFrame([(5, "MEC")], "id long, discipline string")
    rewrite_partitions(changed, str(tmp_path / "t" / "documents"), ["discipline"])
    assert {tuple(r) for r in read_table(spark, str(tmp_path / "t"), "documents").collect()} == {(1, "ELC"), (5, "MEC")}


def test_audit_ignores_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "k string")
    found = A.audit_constraints([("t", df, ["k"])], [])
    assert [tuple(r) for r in found.collect()] == [("unique", "t", "a", 2)]


@pytest.mark.parametrize("outcome, n", [("successful", 1), ("already_exists", 2), ("failed", 1)])
def test_outcomes(spark, outcome, n):
    rows = spark.createDataFrame(
        [(1, "a.pdf", "x"), (2, "b.pdf", "x"), (3, "c.exe", "y"), (4, "d.pdf", "z")], "arrival long, path string, file_hash string"
    ).withColumn("discipline", F.lit(None).cast("string"))
    existing = spark.createDataFrame([("z", 9, "Approved")], "file_hash string, id long, status string")
    assert A.ingest_summary(A.upload_outcomes(rows, existing)).collect()[0][outcome] == n
    assert A.count_outcomes(rows, existing).collect() == A.ingest_summary(A.upload_outcomes(rows, existing)).collect()
    assert A.count_outcomes(rows.limit(0), existing).collect()[0][outcome] == 0


def test_scanned_files_of_the_test_tables(spark, folder):
    found = spark_queries()["scan_files"](spark, folder).collect()
    want = {p.name: p.read_bytes() for p in Path(folder).glob("*.parquet")}
    assert {(r.file_name, r.length, r.n_bytes, r.file_hash) for r in found} == {(n, len(b), len(b), hashlib.sha256(b).hexdigest()) for n, b in want.items()}


def test_long_files_are_read_in_stretches(spark, tmp_path, monkeypatch):
    random, mark = Random(7), b"\xef\xbb\xbf"
    written = {
        "random": random.randbytes(40_000), "ends": random.randbytes(9_000) + b"\n", "mark": mark + b"\n" + random.randbytes(9_000),
        "two marks": mark + mark + random.randbytes(9_000) + b"\n", "newlines": b"\n" * 20_000, "none %20 \u00e9": bytes(9_000),
        "crlf": b"ab\r\n\r" * 3_000, "bound": b"a" * 8_000, "short": b"a",
    }
    for name, data in written.items():
        (tmp_path / f"{name}.parquet").write_bytes(data)
    (tmp_path / "other.pdf").write_bytes(bytes(9_000))
    monkeypatch.setattr(files, "TURN_BYTES", 8_000, raising=False)
    # longer files may not be held as one value
    held = {"spark.sql.sources.binaryFile.maxLength": "8000", "spark.sql.files.maxPartitionBytes": "5000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = spark_queries()["scan_files"](spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {(f"{n}.parquet", len(b), len(b), hashlib.sha256(b).hexdigest()) for n, b in written.items()}
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_long_files_without_newlines_are_read_whole(spark, tmp_path, monkeypatch):
    random = Random(5)
    written = {"zeros": bytes(30_000), "amid": random.randbytes(9_000) + b"a" * 12_000 + random.randbytes(9_000), "random": random.randbytes(30_000)}
    for name, data in written.items():
        (tmp_path / f"{name}.parquet").write_bytes(data)
    monkeypatch.setattr(files, "LINE_BYTES", 4_000)
    for names in (written, ["zeros", "amid"]):
        paths = [str(tmp_path / f"{n}.parquet") for n in names]
        found = files.hashed_files(spark, paths, turn_bytes=8_000).select("path", "length", "n_bytes", "file_hash").collect()
        want = {(f"{n}.parquet", 30_000, 30_000, hashlib.sha256(written[n]).hexdigest()) for n in names}
        assert {(Path(r.path).name, *r[1:]) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("compress", [sha256.plain_compress, sha256.compressor()])
def test_hash_is_carried_on_by_its_state(compress):
    random = Random(3)
    for n in (0, 1, 55, 56, 63, 64, 65, 119, 120, 3_000):
        data, state = random.randbytes(n), sha256.START
        cuts = sorted(random.choices(range(n + 1), k=20))
        for begin, end in zip([0, *cuts], [*cuts, n], strict=True):
            state = sha256.advance(state, data[begin:end], compress)
        assert (sha256.n_bytes(state), sha256.digest(state)) == (n, hashlib.sha256(data).hexdigest())
