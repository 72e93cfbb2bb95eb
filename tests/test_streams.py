"""Streams over several micro-batches against their batch forms."""

from __future__ import annotations

import shutil

import duckdb
from compare import compare
from pyspark.sql import functions as F

from paperloom.operators import activity as M
from paperloom.streaming import activity, ingest, runs, status
from paperloom.streaming.known import HashIndex


def parts(df, path, n):
    """Write ``df`` as ``n`` files in order of its first column, one per append."""
    for i in range(n):
        df.where(F.col(df.columns[0]) % n == i).coalesce(1).write.mode("append").parquet(path)


def one_file_at_a_time(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_status_changes_over_batches(spark, tmp_path):
    rows = []
    for job in range(20):
        for step in range(6):
            rows.append((step % 3, f"j{job}", step, f"2024-01-01 0{step}:00:00", "Approved" if (step, job % 4) in ((3, 0), (4, 1)) else "Checking" if step % 2 or job % 3 else "Other"))
    df = spark.createDataFrame(rows, "part int, job_id string, seq long, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    # each file holds one time range, as files that arrive one after the other would
    path = str(tmp_path / "in")
    for low in (0, 2, 4):
        df.where(F.col("seq").between(low, low + 1)).coalesce(1).write.mode("append").parquet(path)
    stream = status.status_changes(one_file_at_a_time(spark, df.schema, path))
    runs.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.job_id, r.seq, r.status, r.progress) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.job_id, r.seq, r.status, r.progress) for r in M.status_changes(df).collect()}
    assert got == want and any(r[3] == 100 for r in got)


def test_state_of_finished_jobs_goes(spark, tmp_path):
    """Each file is a day. Jobs finish on the first one, other events move the watermark on."""
    day = lambda n, s: f"2024-01-{n:02d} 00:00:{s:02d}"
    days = [
        [(f"j{i}", s, day(1, s), "Approved" if s == 3 else "Checking") for i in range(30) for s in range(6)] + [("open", 0, day(1, 0), "Checking")],
        [("j0", 9, day(2, 9), "Checking"), ("open", 1, day(2, 0), "Checking"), ("open", 2, day(2, 1), "Other")],
        [("open", 3, day(12, 0), "Other")],
        [("open", 4, day(25, 0), "Checking")],
    ]
    schema = "job_id string, seq long, ts string, status string"
    path = str(tmp_path / "in")
    for rows in days:
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    stream = status.status_changes(one_file_at_a_time(spark, "job_id string, seq long, ts timestamp, status string", path))
    running = runs.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    running.awaitTermination()
    held = [max(o["numRowsTotal"] for o in p["stateOperators"]) for p in running.recentProgress if p["stateOperators"]]
    assert max(held) >= 31 and held[-1] <= 2
    got = sorted((r.job_id, r.seq, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.job_id in ("open", "j0", "j7"))
    assert got == [(j, s, x) for j in ("j0", "j7") for s, x in ((0, "Checking"), (3, "Approved"))] + [("open", 0, "Checking"), ("open", 2, "Other"), ("open", 4, "Checking")]


def test_ingest_twice_admits_once(spark, tmp_path):
    rows = spark.range(90).select(
        F.col("id").alias("arrival"), F.concat(F.lit("f"), "id", F.lit(".pdf")).alias("path"), F.lit("ELC").alias("discipline"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), F.col("id") % 20)).alias("file_hash"),
        F.timestamp_seconds(F.col("id") * 86400 * 10).alias("seen_at"),
    )
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    existing = spark.createDataFrame([("h1", 1, "Approved")], "file_hash string, id long, status string")

    def run():
        stream = one_file_at_a_time(spark, rows.schema, path)
        ingest.ingest_stream(stream, lambda: existing, "store", out, str(tmp_path / "cp")).awaitTermination()
        return sorted(r.file_hash for r in spark.read.parquet(out).collect())

    parts(rows, path, 3)
    want = sorted({r.file_hash for r in rows.collect()} - {"h1"})
    assert run() == want
    parts(rows.withColumn("arrival", F.col("arrival") + 1000), path, 2)
    assert run() == want


def test_first_arrival_of_a_hash_is_admitted(spark, tmp_path):
    rows = spark.createDataFrame(
        [(5, "late.dwg", "MEC", "h"), (0, "first.pdf", "ELC", "h"), (1, "b.png", None, "g")], "arrival long, path string, discipline string, file_hash string"
    )
    none = spark.createDataFrame([], "file_hash string")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.coalesce(1).write.parquet(path)
    for _ in range(2):
        stream = one_file_at_a_time(spark, rows.schema, path)
        ingest.ingest_stream(stream, lambda: none, "store", out, str(tmp_path / "cp")).awaitTermination()
        got = {(r.original_path, r.discipline) for r in spark.read.parquet(out).collect()}
        assert got == {("store/h.pdf", "ELC"), ("store/g.png", None)} and spark.read.parquet(out).count() == 2
        rows.where("arrival = 5").withColumn("arrival", F.lit(-1).cast("long")).coalesce(1).write.mode("append").parquet(path)


def hashes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file_hash string")


def test_index_of_known_hashes(spark, tmp_path):
    index = HashIndex(spark, str(tmp_path / "index"))
    asked = hashes(spark, "aa9", "bb9", "zz9")
    names = lambda before: sorted(r.file_hash for r in index.known(asked, before).collect())
    kept = {}
    assert names(5) == []
    index.append(0, hashes(spark, "aa1", "bb1", "cc1", "aa1", None))
    index.append(1, hashes(spark, "aa2", "dd1"))
    index.append(2, hashes(spark, "bb2"))
    assert (names(0), names(1), names(2), names(3)) == ([], ["aa1", "bb1"], ["aa1", "aa2", "bb1"], ["aa1", "aa2", "bb1", "bb2"])
    # of the prefixes, those of the hashes asked for are read: files of others may hold anything
    for prefix in ("cc", "dd"):
        for file in (tmp_path / "index" / "batches").glob(f"*/prefix={prefix}/*.parquet"):
            kept[file] = file.read_bytes()
            file.with_name(f".{file.name}.crc").unlink()
            file.write_bytes(b"nothing")
    assert len(kept) == 2 and names(3) == ["aa1", "aa2", "bb1", "bb2"]
    for file, content in kept.items():
        file.write_bytes(content)
    index.append(2, hashes(spark, "bb3"))  # run again
    index.compact(1)
    assert names(3) == ["aa1", "aa2", "bb1", "bb3"] and names(1) == ["aa1", "bb1"]
    assert index._parts(9) == ([1], [2])
    index.compact(1)
    index.append(3, hashes(spark, "zz1"))
    index.compact(3)
    index.remove_compacted()
    assert names(4) == ["aa1", "aa2", "bb1", "bb3", "zz1"] and index._parts(9) == ([3], [])
    # a base that was not written to its end is not read
    (tmp_path / "index" / "base" / "upto=8" / "prefix=aa").mkdir(parents=True)
    assert names(9) == names(4)


def test_a_batch_that_died_half_way_is_admitted_again(spark, tmp_path):
    """The first micro-batch leaves no index, the second none of its records."""
    rows = spark.range(12).select(F.col("id").alias("arrival"), F.concat(F.lit("f"), "id", F.lit(".pdf")).alias("path"), F.lit("ELC").alias("discipline"), F.concat(F.lit("h"), F.col("id") % 5).alias("file_hash"))
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    parts(rows, path, 3)
    none = hashes(spark).where("false")

    def run():
        ingest.ingest_stream(one_file_at_a_time(spark, rows.schema, path), lambda: none, "store", out, checkpoint, compact_every=1).awaitTermination()
        return sorted(r.file_hash for r in spark.read.parquet(out).collect())

    want = [f"h{i}" for i in range(5)]
    assert run() == want
    before = {p.name for p in (tmp_path / "out" / "batch_id=0").iterdir()}
    shutil.rmtree(tmp_path / "cp" / "commits")
    shutil.rmtree(tmp_path / "cp-hashes")
    for name in ("batch_id=1", "batch_id=2"):
        (tmp_path / "out" / name / "_SUCCESS").unlink()
    shutil.rmtree(tmp_path / "cp" / "offsets")
    shutil.rmtree(tmp_path / "cp" / "sources")
    assert run() == want
    assert {p.name for p in (tmp_path / "out" / "batch_id=0").iterdir()} == before


def test_windows_and_rules_per_batch(spark, tmp_path):
    actions = spark.range(400).select(
        F.col("id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 900).alias("created_at"), (F.col("id") % 5 != 0).alias("success"),
        F.when(F.col("id") % 4 != 0, F.col("id") / 400.0).alias("confidence"),
    )
    path = str(tmp_path / "in")
    for low in (0, 200):
        actions.where(F.col("id").between(low, low + 199)).coalesce(1).write.mode("append").parquet(path)
    stream = activity.activity_windows(one_file_at_a_time(spark, actions.schema, path))
    runs.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in M.activity_windows(actions).collect()}
    assert got and got <= want


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    """A folder of more files than a trigger takes otherwise, in no order of arrival, gives what the SQL does."""
    for name in ("documents", "labels"):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        table.repartition(20).sortWithinPartitions(F.col("doc_id").desc()).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert compare(spark, con, str(tmp_path), "ingest_stream").startswith("same")


def test_events_after_a_final_status_are_left_out(spark):
    """Of a thousand jobs with a final event on their third of 50, three events each are left before any state is asked."""
    events = spark.range(50_000).select(
        F.when(F.col("id") % 1000 > 0, F.concat(F.lit("j"), F.col("id") % 1000)).alias("job_id"), F.col("id").alias("seq"),
        F.timestamp_seconds(F.expr("1704067200 + id div 1000 * 3600")).alias("ts"),
        F.when(F.expr("id div 1000 % 3 = 2"), "Approved").otherwise("Checking").alias("status"),
    )
    odd = spark.createDataFrame([("j1", None, "2030-01-01 00:00:00", "Approved"), ("j2", 5, None, "Approved"), ("j3", 9, "2025-01-01 00:00:00", None)], "job_id string, seq long, ts string, status string")
    every = events.unionByName(odd.withColumn("ts", F.col("ts").cast("timestamp"))).coalesce(1)
    left = every.mapInArrow(status.until_final, every.schema)
    per_job = {r[0]: r[1] for r in left.groupBy("job_id").count().collect()}
    # the event without a number is the latest one, that without a time cannot be placed
    assert per_job == {j: 3 + (j in ("j1", "j2")) for j in [None, *(f"j{i}" for i in range(1, 1000))]}
