"""Starting streaming queries; `available_now` runs over what is there and stops."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from opsight.sources.manifest import Files


def _triggered(writer, every: str | None):
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which keyed state with timers needs."""
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def append_to(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append results to parquet; without `every` the query ends when the available input is used up."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path)
    return _triggered(writer.option("checkpointLocation", checkpoint), every).start()


def load_ids(spark: SparkSession, checkpoint: str) -> Callable[[int], str]:
    """Names of micro-batches that no other stream or checkpoint uses: the id in the checkpoint, then the number.

    The id is there once the first micro-batch runs; it is read once.
    """
    known: list[str] = []

    def name(batch_id: int) -> str:
        if not known:
            known.append(json.loads(Files(spark, checkpoint).read(f"{checkpoint}/metadata"))["id"])
        return f"{known[0]}-{batch_id}"

    return name


def each_batch(
    df: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Run `action(batch, batch_id)` per micro-batch; it must be repeatable for the same id."""
    writer = df.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    return _triggered(writer, every).start()


def appended(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """Run an append query over the available input to the end and read its result back."""
    append_to(df, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")
