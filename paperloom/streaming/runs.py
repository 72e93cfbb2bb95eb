"""Starting streaming queries: state store, checkpoints and sinks."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State larger than memory; the provider is read when a query starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval: str = "1 minute"):
    """Append the stream to Parquet files. With ``available_now`` the query ends when all present input is done."""
    writer = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    with rocksdb_state(stream.sparkSession):
        return writer.start()


def for_each_batch(stream: DataFrame, work, checkpoint: str, available_now: bool = True, interval: str = "1 minute"):
    """Run ``work(batch, batch_id)`` on every micro-batch."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    with rocksdb_state(stream.sparkSession):
        return writer.start()
