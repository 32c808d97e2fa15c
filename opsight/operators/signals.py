"""Conditions that combine several signals about the same order, station or channel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.functions import (
    as_double,
    as_long,
    lookup,
    payload_fields,
    recent,
    span,
    text,
    until,
)
from opsight.operators.dashboard import station_load
from opsight.operators.operational import MIN_DELAY, MIN_QUEUE, negative_signals
from opsight.operators.questions import critical_now, kitchen_state, saturated_stations
from opsight.operators.rules import channel_saturation
from opsight.schemas import ORDER_DELAYED, SENTIMENT

When = str | dt.datetime

SLA_MINUTES = 10

# --- fixed values: feedback levels that count as a customer signal ---
POOR_FEEDBACK = ("negativo", "muy_negativo")
# ---------------------------------------------------------------------


def _late(orders: DataFrame, min_delay: float) -> DataFrame:
    return orders.where((F.col("event_name") == ORDER_DELAYED) & (F.col("delay_minutes") >= min_delay))


def _unhappy_orders(orders: DataFrame) -> DataFrame:
    """One row per order with a negative signal."""
    return negative_signals(orders).select("order_id").distinct().withColumn("negative_sentiment", F.lit(True))


def _with_sentiment(df: DataFrame, orders: DataFrame) -> DataFrame:
    return lookup(df, _unhappy_orders(orders), "order_id").withColumn(
        "negative_sentiment", F.coalesce("negative_sentiment", F.lit(False))
    )


def sla_risk_with_customer_signal(
    orders: DataFrame, min_delay: float = MIN_DELAY, max_sla: float = SLA_MINUTES
) -> DataFrame:
    """Late orders short of time whose customer shows at least one sensitive signal."""
    sla, feedback, cancelled, premium = payload_fields(
        "sla_remaining", "feedback", "cancellation_history", "is_premium"
    )
    late = (
        _late(orders, min_delay)
        .select(
            "event_time",
            "event_id",
            "order_id",
            "channel",
            "station_id",
            "delay_minutes",
            as_double(sla).alias("sla_remaining"),
            text(feedback).isin(*POOR_FEEDBACK).alias("negative_feedback"),
            (~text(cancelled).isin("", "none")).alias("cancelled_before"),
            (text(premium) == "true").alias("is_premium"),
        )
        .where(F.col("sla_remaining") <= max_sla)
    )
    signals = ("negative_sentiment", "negative_feedback", "cancelled_before", "is_premium")
    reasons = F.concat_ws(",", *[F.when(F.col(s), F.lit(s)) for s in signals])
    return (
        _with_sentiment(late, orders)
        .withColumn("reasons", reasons)
        .where(F.col("reasons") != "")
        .select(
            "event_time",
            "event_id",
            "order_id",
            "channel",
            "station_id",
            "delay_minutes",
            "sla_remaining",
            *signals,
            "reasons",
            F.lit("ReprioritizeOrder").alias("recommended_action"),
        )
    )


def _stock_is_critical(inventory: DataFrame, as_of: When, lookback: str):
    """Whether any ingredient is critical now, as a scalar subquery: one value, no join."""
    return critical_now(inventory, as_of, lookback).agg((F.count("*") > 0).alias("critical")).scalar()


def station_bottlenecks(
    orders: DataFrame,
    kitchen: DataFrame,
    inventory: DataFrame,
    stations: DataFrame,
    as_of: When,
    load_lookback: str = "10m",
    state_lookback: str = "30m",
    stock_lookback: str = "60m",
    min_delay: float = MIN_DELAY,
    min_queue: int = MIN_QUEUE,
    delay_lookback: str | None = None,
) -> DataFrame:
    """Stations over capacity or with a high reported queue that already have delays; low stock raises the priority.

    Delays count over the whole history up to `as_of` unless `delay_lookback` bounds them.
    """
    delays = (
        _late(until(orders, as_of, delay_lookback), min_delay)
        .groupBy("station_id")
        .agg(F.count("*").alias("delayed_orders"))
    )
    state = kitchen_state(kitchen, as_of, state_lookback).select("station_id", "reported_queue")
    return (
        stations.join(station_load(orders, as_of, load_lookback), "station_id", "left")
        .join(state, "station_id", "left")
        .join(delays, "station_id")
        .withColumn("active_orders", F.coalesce("active_orders", F.lit(0)))
        .where((F.col("active_orders") > F.col("max_capacity")) | (F.col("reported_queue") >= min_queue))
        .withColumn("critical_stock_present", _stock_is_critical(inventory, as_of, stock_lookback))
        .select(
            "station_id",
            "display_name",
            "active_orders",
            "max_capacity",
            "reported_queue",
            "delayed_orders",
            "critical_stock_present",
            F.when(F.col("critical_stock_present"), "critical").otherwise("urgent").alias("priority"),
            F.lit("ReprioritizeOrder").alias("recommended_action"),
        )
    )


def signal_correlation(
    orders: DataFrame,
    kitchen: DataFrame,
    inventory: DataFrame,
    stations: DataFrame,
    as_of: When,
    lookback: str = "10m",
    state_lookback: str = "30m",
    stock_lookback: str = "60m",
    channel_width: str = "5m",
    min_delay: float = MIN_DELAY,
    signal_lookback: str | None = None,
    delay_lookback: str | None = None,
) -> DataFrame:
    """Per delay event up to `as_of`: five signals and how many of them hold.

    Station load is that of the last `lookback`. Delays and customer signals count over the whole history;
    `delay_lookback` and `signal_lookback` bound them where that is wanted.
    """
    delayed = (
        until(orders, as_of, delay_lookback)
        .where(F.col("event_name") == ORDER_DELAYED)
        .select("event_time", "event_id", "order_id", "channel", "station_id", "delay_minutes")
    )
    crowded = (
        channel_saturation(until(orders, as_of, delay_lookback), channel_width, channel=None, min_delay=min_delay)
        .select(F.col("event_time").alias("bucket"), "channel")
        .withColumn("channel_accumulating", F.lit(True))
    )
    saturated = (
        saturated_stations(orders, kitchen, stations, as_of, lookback, state_lookback)
        .select("station_id")
        .withColumn("station_saturated", F.lit(True))
    )
    placed = delayed.withColumn("bucket", _bucket_start(channel_width)).join(
        saturated, "station_id", "left"
    )
    flags = ("is_delayed", "station_saturated", "low_stock", "channel_accumulating", "negative_sentiment")
    return (
        _with_sentiment(lookup(placed, crowded, "channel", "bucket"), until(orders, as_of, signal_lookback))
        .withColumns(
            {
                "is_delayed": F.coalesce(F.col("delay_minutes") >= min_delay, F.lit(False)),
                "station_saturated": F.coalesce("station_saturated", F.lit(False)),
                "channel_accumulating": F.coalesce("channel_accumulating", F.lit(False)),
                "low_stock": _stock_is_critical(inventory, as_of, stock_lookback),
            }
        )
        .withColumn("signal_count", sum((F.col(f).cast("int") for f in flags), F.lit(0)))
        .select(
            "event_time",
            "event_id",
            "order_id",
            "channel",
            "station_id",
            "delay_minutes",
            *flags,
            "signal_count",
        )
    )


def _bucket_start(width: str):
    """Start of the tumbling bucket of `event_time`, as `bucketed` computes it."""
    return F.window("event_time", f"{int(span(width).total_seconds())} seconds").getField("start")


def delay_over_capacity(
    orders: DataFrame,
    stations: DataFrame,
    as_of: When,
    lookback: str = "10m",
    min_delay: float = MIN_DELAY,
    delay_lookback: str | None = None,
) -> DataFrame:
    """Late orders up to `as_of` (at most `delay_lookback` old, if given) whose station has more active orders than it can handle."""
    overloaded = (
        stations.join(station_load(orders, as_of, lookback), "station_id")
        .where(F.col("active_orders") > F.col("max_capacity"))
        .select("station_id", "display_name", "active_orders", "max_capacity")
    )
    late = _late(until(orders, as_of, delay_lookback), min_delay).select(
        "event_time", "event_id", "order_id", "channel", "station_id", "delay_minutes"
    )
    return late.join(overloaded, "station_id").select(
        "event_time",
        "event_id",
        "order_id",
        "channel",
        "station_id",
        "display_name",
        "delay_minutes",
        "active_orders",
        "max_capacity",
    )


def compensation_candidates(orders: DataFrame, min_delay: float = MIN_DELAY) -> DataFrame:
    """Orders with both a long enough delay and a negative signal, one row each.

    Both sides are counted in one pre-aggregated pass over the order events, so no pairs are formed.
    """
    sentiment = F.when(F.col("event_name") == SENTIMENT, payload_fields("sentiment")[0])
    rows = orders.where(F.col("event_name").isin(ORDER_DELAYED, SENTIMENT)).select(
        "order_id",
        "event_time",
        "delay_minutes",
        F.coalesce((F.col("event_name") == ORDER_DELAYED) & (F.col("delay_minutes") >= min_delay), F.lit(False)).alias(
            "late"
        ),
        F.coalesce(sentiment == "negative", F.lit(False)).alias("unhappy"),
    )
    return (
        rows.groupBy("order_id")
        .agg(
            F.count_if("late").alias("delays"),
            F.max(F.when(F.col("late"), F.col("delay_minutes"))).alias("max_delay"),
            F.max(F.when(F.col("late"), F.col("event_time"))).alias("last_delay"),
            F.count_if("unhappy").alias("negative_signals"),
            F.max(F.when(F.col("unhappy"), F.col("event_time"))).alias("last_signal"),
        )
        .where("delays > 0 and negative_signals > 0")
        .withColumn("action", F.lit("action.compensation.issued"))
    )
