"""Windowed and joined streaming queries. `late` is how long the watermark waits for late events.

The optimizer moves a filter on event names below the watermark, which then follows the matching events only. Where
matches are rare, the conditions sit inside the aggregate instead, so that all events advance the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.functions import as_long, bucketed, not_blank, payload_fields, span
from opsight.operators.operational import MIN_AVG_QUEUE, MIN_DELAY, MIN_QUEUE, delayed_with_queue, low_stock
from opsight.operators.operational import negative_signals
from opsight.operators.quality import LIFECYCLE
from opsight.operators.routing import route_inventory, route_kitchen, route_orders
from opsight.operators.rules import MIN_OCCURRENCES
from opsight.schemas import ORDER_DELAYED, ORDER_PAID


def _interval(width: str) -> str:
    return f"{int(span(width).total_seconds())} seconds"


def _watched(df: DataFrame, late: str) -> DataFrame:
    return df.withWatermark("event_time", _interval(late))


def stream_throughput(raw: DataFrame, width: str = "1m", late: str = "10m") -> DataFrame:
    """Events per bucket and event name."""
    return bucketed(_watched(raw, late), width, ["event_name"], F.count("*").alias("Events"))


def stream_saturation(
    raw: DataFrame, width: str = "5m", late: str = "10m", min_queue: int = MIN_QUEUE, min_avg: float = MIN_AVG_QUEUE
) -> DataFrame:
    """Station buckets with a high queue; station readings are frequent, so they may drive the watermark."""
    (queue,) = payload_fields("queue_size")
    readings = route_kitchen(_watched(raw, late)).select("event_time", "station_id", as_long(queue).alias("queue_size"))
    return bucketed(
        readings,
        width,
        ["station_id"],
        F.max("queue_size").alias("max_queue"),
        F.avg("queue_size").alias("avg_queue"),
        F.count("*").alias("events"),
    ).where((F.col("max_queue") >= min_queue) | (F.col("avg_queue") >= min_avg))


def stream_channel_saturation(
    raw: DataFrame,
    width: str = "5m",
    late: str = "10m",
    channel: str = "delivery",
    min_delay: float = MIN_DELAY,
    min_count: int = MIN_OCCURRENCES,
) -> DataFrame:
    """Buckets in which delays accumulate on a channel; every event advances the watermark."""
    (delay,) = payload_fields("delay_minutes")
    minutes = delay.try_cast("double")
    counts = (F.col("event_name") == ORDER_DELAYED) & (F.col("channel") == channel) & (minutes >= min_delay)
    return (
        bucketed(
            _watched(raw, late),
            width,
            [],
            F.count_if(counts).alias("delayed_count"),
            F.max(F.when(counts, minutes)).alias("max_delay"),
        )
        .where(F.col("delayed_count") >= min_count)
        .select("event_time", F.lit(channel).alias("channel"), "delayed_count", "max_delay")
        .withColumn("severity", F.lit("warning"))
    )


def stream_delay_sentiment(raw: DataFrame, within: str = "1h", late: str = "10m") -> DataFrame:
    """Delayed orders with a negative signal at most `within` before or after the delay.

    Rows without a signal come out once both event kinds have moved past the time limit, so a closing event of each
    kind is needed to see the last ones. Each side has a watermark of its own, and the slower one counts. Delays
    without an order id belong to no signal; they go past the join, so a blank id is no key of its state.
    """
    delayed = delayed_with_queue(route_orders(_watched(raw, late))).select(
        F.col("event_time").alias("delay_time"),
        F.col("order_id").alias("delayed_order"),
        "channel",
        "station_id",
        "delay_minutes",
        "queue_size",
    )
    signals = negative_signals(route_orders(_watched(raw, late))).where(not_blank("order_id")).select(
        F.col("event_time").alias("signal_time"), "order_id", "reason"
    )
    near = F.expr(f"INTERVAL {_interval(within)}")
    same_order = F.col("order_id") == F.col("delayed_order")
    in_time = (F.col("signal_time") >= F.col("delay_time") - near) & (
        F.col("signal_time") <= F.col("delay_time") + near
    )
    named = delayed.where(not_blank("delayed_order")).join(signals, same_order & in_time, "left").drop("order_id")
    nameless = delayed.where(~not_blank("delayed_order")).withColumns(
        {"signal_time": F.lit(None).cast("timestamp"), "reason": F.lit(None).cast("string")}
    )
    return named.unionByName(nameless).select(
        "delay_time",
        F.col("delayed_order").alias("order_id"),
        "channel",
        "station_id",
        "delay_minutes",
        "queue_size",
        "signal_time",
        "reason",
    )


def stream_alerts_once(raw: DataFrame, late: str = "10m") -> DataFrame:
    """Event-level alerts, each reported once even if it is delivered again within the watermark."""

    def hits(df: DataFrame, rule: str, key: str) -> DataFrame:
        return df.select("event_time", "event_id", F.lit(rule).alias("rule"), F.col(key).alias("key"))

    delayed = hits(delayed_with_queue(route_orders(_watched(raw, late))), "DelayedOrderHighQueue", "order_id")
    stock = hits(low_stock(route_inventory(_watched(raw, late))), "CriticalInventory", "ingredient_id")
    return delayed.unionByName(stock).dropDuplicatesWithinWatermark(["rule", "key", "event_time", "event_id"])


def stream_open_orders(raw: DataFrame, patience: str = "1h", late: str = "10m") -> DataFrame:
    """Orders that were opened and then went quiet for `patience` without a payment.

    Event-time sessions per order: state is a few counters per order and is dropped when the session closes. Steps
    without an order id are left out: together they would be one session that never closes.
    """
    steps = _watched(raw, late).where(F.col("event_name").isin(*LIFECYCLE) & not_blank("order_id"))
    sessions = steps.groupBy("order_id", F.session_window("event_time", _interval(patience)).alias("session")).agg(
        F.count_if(F.col("event_name") != ORDER_PAID).alias("opened"),
        F.count_if(F.col("event_name") == ORDER_DELAYED).alias("delays"),
        F.count_if(F.col("event_name") == ORDER_PAID).alias("payments"),
    )
    return sessions.where("opened > 0 and payments = 0").select(
        "order_id",
        F.col("session.start").alias("opened_at"),
        F.col("session.end").alias("overdue_at"),
        "opened",
        "delays",
    )
