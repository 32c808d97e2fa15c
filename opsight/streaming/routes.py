"""Streaming ingest: raw events into all tables, and the current state of orders."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opsight.functions import latest_by
from opsight.operators.rollups import minute_rollup
from opsight.operators.routing import fan_out
from opsight.schemas import ORDER_STATES, QUARANTINE, ROLLUP
from opsight.sources.events import landed_and_rejected
from opsight.sources.tables import BUCKETS, MERGE_FAN, merge_order_states, read_table, write_table
from opsight.streaming.runner import each_batch, load_ids


def stream_route(
    raw: DataFrame, root: str, checkpoint: str, every: str | None = None, rollup: bool = False
) -> StreamingQuery:
    """Write each micro-batch into raw and the six tables; a repeated batch takes the place of its first try.

    With `rollup` its partial aggregates are published along with it, for dashboards that refresh often.
    """
    named = load_ids(raw.sparkSession, checkpoint)

    def route(batch: DataFrame, batch_id: int) -> None:
        fan_out(batch, root, named(batch_id), also={ROLLUP: minute_rollup} if rollup else None)

    return each_batch(raw, route, checkpoint, every)


def stream_landing(parsed: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """As `stream_route`, for a stream of parsed input: what cannot be read goes into the quarantine of the same load.

    Each micro-batch is parsed once, and its events and rejected lines are published together, so after a failure a
    line is neither lost nor there twice. `read_table(spark, root, QUARANTINE)` has them by reason.
    """
    named = load_ids(parsed.sparkSession, checkpoint)

    def land(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            landed, rejected = landed_and_rejected(kept)
            fan_out(landed, root, named(batch_id), also={QUARANTINE: lambda _: rejected})
        finally:
            kept.unpersist()

    return each_batch(parsed, land, checkpoint, every)


def stream_order_states(
    orders: DataFrame, root: str, checkpoint: str, every: str | None = None, merge_every: int = MERGE_FAN
) -> StreamingQuery:
    """Keep a change log with the newest event per order and micro-batch, merged level by level.

    Each batch is reduced on its own, so the query holds no state that would grow with the number of orders. Every
    `merge_every` batches full levels of the log are merged, so readers meet few files however long the stream has run.
    The log has a table of its own, so routed orders on the same root stay as they are, and `expire` leaves it alone:
    an old order may still be open.
    """
    named = load_ids(orders.sparkSession, checkpoint)

    def keep(batch: DataFrame, batch_id: int) -> None:
        write_table(latest_by(batch, "order_id"), root, ORDER_STATES, named(batch_id))
        if (batch_id + 1) % merge_every == 0:
            merge_order_states(batch.sparkSession, root, merge_every)

    return each_batch(orders, keep, checkpoint, every)


def current_orders(spark: SparkSession, root: str, order_ids: list[str] | None = None) -> DataFrame:
    """The newest event per order: merged runs of the change log and what came since.

    `order_ids`, a short list, reads only the buckets these orders are in.
    """
    log = read_table(spark, root, ORDER_STATES)
    if order_ids is not None:
        # the hash of a literal is folded, so the buckets prune folders
        buckets = [F.pmod(F.xxhash64(F.lit(i)), F.lit(BUCKETS)).cast("int") for i in order_ids]
        log = log.where(F.col("order_id").isin(order_ids) & F.col("bucket").isin(*buckets)) if order_ids else log.limit(0)
    return latest_by(log, "order_id").drop("bucket")
