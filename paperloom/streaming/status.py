"""Status changes of jobs as a stream, in two stateful steps.

Before them, events that follow a final status of their job are left out, a batch of rows at a time: where the rows stand, and
again where those of a job and month have come together. What is left of most jobs is a few events. The first stateful step leaves one row per change of a day of a job in a micro-batch, so that a job with many events is worked on by many
tasks and hands only its changes to the second step. It is keyed by a hash of job and day and works on all days of a key at
once, since most days of most jobs have a few events only. The second step is keyed by job and holds its last status.
When a job has finished, a timer is set in event time; once the watermark has passed it, the state of the job is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom.constants import FINAL_STATUSES
from paperloom.operators.activity import status_message
from paperloom.operators.reports import progress_of

_EVENT = "job_id string, seq long, ts timestamp, status string"
_COLUMNS = ["job_id", "seq", "ts", "status"]
# keys of the first step: each holds its share of the events of a micro-batch
BUCKETS = 1024
ROWS_AT_ONCE = 500_000


def _up_to_final(events: pa.Table) -> pa.Table:
    """The events that do not follow a final status of their job among these, by (ts, seq), and the latest; events without either stay."""
    job = pc.fill_null(events["job_id"].combine_chunks().dictionary_encode().indices, -1).to_numpy() + 1
    ts, seq = (pc.fill_null(events[c].cast(pa.int64()), np.iinfo(np.int64).min).to_numpy() for c in ("ts", "seq"))
    placed = pc.and_(events["ts"].is_valid(), events["seq"].is_valid())
    final = np.flatnonzero(pc.and_(pc.is_in(events["status"], pa.array(sorted(FINAL_STATUSES))), placed).to_numpy())
    final = final[np.lexsort((seq[final], ts[final], job[final]))]
    first = final[np.diff(job[final], prepend=-1) != 0]
    last_ts, last_seq = (np.full(job.max(initial=0) + 1, np.iinfo(np.int64).max) for _ in range(2))
    last_ts[job[first]], last_seq[job[first]] = ts[first], seq[first]
    kept = (ts < last_ts[job]) | ((ts == last_ts[job]) & (seq <= last_seq[job]))
    kept[np.argmax(ts)] = True  # the watermark follows all events
    return events.filter(pa.array(kept))


def until_final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_up_to_final`` of every ``ROWS_AT_ONCE`` rows of a task."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS_AT_ONCE:
            yield from _up_to_final(pa.Table.from_batches(held)).to_batches()
            held, n = [], 0
    if held:
        yield from _up_to_final(pa.Table.from_batches(held)).to_batches()


class DailyChanges(StatefulProcessor):
    """Of the events of some days of some jobs in a micro-batch, each day in the order of (ts, seq), those whose status is not that of the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True)
        # equal numbers for equal values, nulls included
        numbers = [pd.factorize(events[c])[0] for c in ("job_id", "day", "status")]
        order = np.lexsort((events["seq"], events["ts"], numbers[1], numbers[0]))
        changed = np.any([np.diff(n[order], prepend=-2) != 0 for n in numbers], axis=0)
        yield events.iloc[order[changed]][_COLUMNS]

    def close(self) -> None:
        pass


class LastStatus(StatefulProcessor):
    """Keeps the last status of a job and lets only changes through, until a final status has been seen.

    The changes of a micro-batch are put in order by (ts, seq). Between micro-batches, arrival decides. ``keep`` after the event
    that finished the job, its state goes.
    """

    def __init__(self, keep: timedelta):
        self.keep = int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self._last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._last.get()
        seen, last = held is not None, held and held[0]
        if last in FINAL_STATUSES:
            return
        found = []
        for event in sorted(rows, key=lambda e: (e["ts"], e["seq"])):
            if event["status"] != last or not seen:
                found.append(event)
                last, seen = event["status"], True
            if last in FINAL_STATUSES:
                self.handle.registerTimer(int(event["ts"].replace(tzinfo=UTC).timestamp() * 1000) + self.keep)
                break
        if found:
            self._last.update((last,))
        yield from found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._last.clear()
        return iter(())

    def close(self) -> None:
        pass


def status_changes(events: DataFrame, lateness: str = "1 day", keep: timedelta = timedelta(days=7)) -> DataFrame:
    """Stream of job_id, seq, ts, status -> job_id, seq, ts, status, progress.

    Events that are late by more than ``lateness`` are dropped, and nothing is remembered of a job that finished ``keep`` before
    the watermark. A key of the first step holds a 1024th of the events of a micro-batch, or those of one day of a job if they
    are more: bound it with maxFilesPerTrigger or maxBytesPerTrigger at the source.
    """
    rows = events.select("job_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "status").mapInArrow(until_final, _EVENT)
    met = rows.repartition("job_id", F.date_trunc("month", "ts")).mapInArrow(until_final, _EVENT)
    dated = met.withWatermark("ts", lateness).withColumn("day", F.date_trunc("day", "ts"))
    bucketed = dated.withColumn("bucket", F.pmod(F.xxhash64("job_id", "day"), F.lit(BUCKETS)))
    daily = bucketed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=DailyChanges(), outputStructType=_EVENT, outputMode="append", timeMode="eventTime", eventTimeColumnName="ts"
    )
    # jobs have few changes each: as rows, which do not become a frame per job
    changes = daily.groupBy("job_id").transformWithState(
        statefulProcessor=LastStatus(keep), outputStructType=_EVENT, outputMode="append", timeMode="eventTime", eventTimeColumnName="ts"
    )
    return changes.withColumn("progress", progress_of(F.col("status")))


def status_messages(changes: DataFrame) -> DataFrame:
    return changes.select("job_id", "seq", status_message().alias("message"))
