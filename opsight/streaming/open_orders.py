"""Open orders with keyed state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsight.functions import not_blank, span
from opsight.operators.quality import LIFECYCLE
from opsight.schemas import ORDER_DELAYED, ORDER_PAID, layout

BUCKETS = 1 << 14
_RAW_OVERDUE = layout("order_id string, opened bigint, delays bigint, first bigint, until bigint")


class OpenOrders(StatefulProcessor):
    """Stretches of activity of the orders of a bucket, and one timer at the earliest end of a stretch.

    A step moves the end of its order's stretch, and joins stretches that it bridges. At the end, when an order has been
    quiet for long enough, it comes out if it was opened and not paid, and its state goes; a payment, late or early,
    leaves the timer nothing to report. A bucket is read, written and given its timer at once: a call to the state store
    takes longer than all work on an order. Times are microseconds, timers milliseconds.
    """

    def __init__(self, patience: int):
        self._patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        stretch = "order_id string, first long, until long, opened long, delays long, payments long"
        self._bucket = handle.getValueState("bucket", f"timer long, stretches array<struct<{stretch}>>")

    def _timer(self, until: int) -> int:
        return -(-until // 1000)

    def _held(self) -> tuple[int | None, dict[str, dict[int, tuple]]]:
        """The timer, and (until, opened, delays, payments) by order and start."""
        timer, stretches = self._bucket.get() or (None, [])
        orders: dict[str, dict[int, tuple]] = {}
        for order, first, *value in stretches:
            orders.setdefault(order, {})[first] = tuple(value)
        return timer, orders

    def _hold(self, orders: dict[str, dict[int, tuple]]) -> int | None:
        """Writes the stretches and gives the time of the next end."""
        stretches = [(order, first, *value) for order, own in orders.items() for first, value in own.items()]
        if not stretches:
            self._bucket.clear()
            return None
        timer = min(self._timer(until) for _, _, until, *_ in stretches)
        self._bucket.update((timer, stretches))
        return timer

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before, orders = self._held()
        for row in rows:
            now = orders.setdefault(row.order_id, {})
            first, until = row.at, row.at + self._patience
            counts = (row.opened, row.delays, row.payments)
            for start, (end, *more) in list(now.items()):
                if start < until and first < end:
                    first, until = min(first, start), max(until, end)
                    counts = tuple(a + b for a, b in zip(counts, more))
                    del now[start]
            now[first] = (until, *counts)
        timer = self._hold(orders)
        if timer != before:
            if before is not None:
                self._handle.deleteTimer(before)
            self._handle.registerTimer(timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        # timers up to the watermark fire, so all stretches that end by then are over
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        _, orders = self._held()
        over = []
        for order, own in orders.items():
            for first, value in list(own.items()):
                if self._timer(value[0]) <= due:
                    over.append((order, first, *own.pop(first)))
        timer = self._hold(orders)
        if timer is not None:
            self._handle.registerTimer(timer)
        for order, first, until, opened, delays, payments in over:
            if opened and not payments:
                yield Row(order_id=order, opened=opened, delays=delays, first=first, until=until)

    def close(self) -> None:
        pass


def stream_overdue_orders(raw: DataFrame, patience: str = "1h", late: str = "10m", buckets: int = BUCKETS) -> DataFrame:
    """Orders that were opened and then went quiet for `patience` without a payment.

    The same answers as `stream_open_orders`, from state that a step, a payment or the passing of time changes. Steps
    without an order id hold no state. Orders share the state of a bucket by a hash of their id; a checkpoint keeps its
    number of buckets. Needs the RocksDB state store (`runner.rocksdb_state`).
    """
    width = int(span(patience).total_seconds() * 1_000_000)
    steps = (
        raw.withWatermark("event_time", f"{int(span(late).total_seconds())} seconds")
        .where(F.col("event_name").isin(*LIFECYCLE) & not_blank("order_id"))
        .select(
            F.pmod(F.xxhash64("order_id"), F.lit(buckets)).alias("bucket"),
            "order_id",
            "event_time",
            F.unix_micros("event_time").alias("at"),
            F.when(F.col("event_name") != ORDER_PAID, 1).otherwise(0).cast("long").alias("opened"),
            F.when(F.col("event_name") == ORDER_DELAYED, 1).otherwise(0).cast("long").alias("delays"),
            F.when(F.col("event_name") == ORDER_PAID, 1).otherwise(0).cast("long").alias("payments"),
        )
    )
    found = steps.groupBy("bucket").transformWithState(OpenOrders(width), _RAW_OVERDUE, "Append", "EventTime")
    return found.select(
        "order_id",
        F.timestamp_micros("first").alias("opened_at"),
        F.timestamp_micros("until").alias("overdue_at"),
        "opened",
        "delays",
    )
