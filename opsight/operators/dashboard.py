"""Dashboard queries, evaluated at an explicit `as_of`."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.functions import bucketed, is_open, latest_by, not_blank, ratio, recent, start_of_day, until
from opsight.operators.operational import decision_trace, low_stock, newest_first
from opsight.schemas import ORDER_CREATED, ORDER_DELAYED, ORDER_PAID

When = str | dt.datetime


def station_load(orders: DataFrame, as_of: When, lookback: str = "10m") -> DataFrame:
    """Active orders per station: the newest state per order and station, closed ones dropped."""
    states = recent(orders, as_of, lookback).select("event_time", "event_id", "order_id", "station_id", "order_status")
    return (
        latest_by(states, "order_id", "station_id")
        .where(is_open("order_status"))
        .groupBy("station_id")
        .agg(F.count("*").alias("active_orders"))
    )


def _orders_of_the_day(orders: DataFrame, as_of: When, *names: str) -> DataFrame:
    """One row per order of the day with one flag per event name.

    Membership in several day lists (created, not paid, ...) is read off these flags: one scan and one shuffle of
    pre-aggregated flags, where separate lists would need a shuffle each and a join.
    """
    flags = [F.max(F.col("event_name") == name).alias(name.replace(".", "_")) for name in names]
    return (
        recent(orders, as_of, since=start_of_day(as_of))
        .where(F.col("event_name").isin(*names))
        .groupBy("order_id")
        .agg(*flags)
    )


def _total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("Total"))


def orders_today(orders: DataFrame, as_of: When, approximate: bool = False) -> DataFrame:
    """Distinct orders created since the start of the day; `approximate` trades exactness for a constant-size sketch."""
    created = recent(orders, as_of, since=start_of_day(as_of)).where(F.col("event_name") == ORDER_CREATED)
    distinct = F.approx_count_distinct("order_id") if approximate else F.count_distinct("order_id")
    return created.agg(distinct.alias("Total"))


def active_orders(orders: DataFrame, as_of: When) -> DataFrame:
    """Orders created today and not paid today."""
    day = _orders_of_the_day(orders, as_of, ORDER_CREATED, ORDER_PAID)
    return _total(day.where("order_created and not payment_completed"))


def completed_today(orders: DataFrame, as_of: When) -> DataFrame:
    """Orders created and paid today."""
    day = _orders_of_the_day(orders, as_of, ORDER_CREATED, ORDER_PAID)
    return _total(day.where("order_created and payment_completed"))


def completed_with_delay(orders: DataFrame, as_of: When) -> DataFrame:
    """Orders created, delayed and paid today."""
    day = _orders_of_the_day(orders, as_of, ORDER_CREATED, ORDER_DELAYED, ORDER_PAID)
    return _total(day.where("order_created and order_prep_delayed and payment_completed"))


def throughput(raw: DataFrame, width: str = "1m") -> DataFrame:
    """Raw events per bucket and event name, oldest first."""
    counts = bucketed(raw, width, ["event_name"], F.count("*").alias("Events"))
    return counts.orderBy("event_time", "event_name")


def delayed_orders(
    orders: DataFrame, as_of: When, lookback: str = "10m", top: int = 50, delay_lookback: str | None = None
) -> DataFrame:
    """The newest delay events up to `as_of` (at most `delay_lookback` old, if given) with the live load of their station.

    The load has one row per station, so cutting to `top` before the join gives the same rows and leaves the join a
    handful of rows instead of all delay events.
    """
    delays = until(orders.where(F.col("event_name") == ORDER_DELAYED), as_of, delay_lookback)
    newest = (
        newest_first(delays, "event_time", "event_id")
        .select("event_time", "event_id", "order_id", "channel", "station_id", "delay_minutes", "severity")
        .limit(top)
    )
    return newest_first(
        newest.join(station_load(orders, as_of, lookback), "station_id", "left").select(
            "event_time",
            "event_id",
            "order_id",
            "channel",
            "station_id",
            "delay_minutes",
            F.coalesce("active_orders", F.lit(0)).alias("active_orders"),
            "severity",
        ),
        "event_time",
        "event_id",
    ).drop("event_id")


def load_pct(load: str, capacity: str = "max_capacity"):
    """Load in percent of capacity, one decimal; 0 without capacity."""
    return F.when(F.col(capacity) > 0, F.round(ratio(100.0 * F.col(load), capacity), 1)).otherwise(F.lit(0.0))


def drain_minutes(overflow, capacity: str = "max_capacity", prep: str = "avg_prep_minutes"):
    """Minutes to work off what exceeds capacity, one decimal; 0 when nothing does."""
    needed = F.round(ratio(overflow.cast("double") * F.col(prep), capacity), 1)
    return F.when((overflow > 0) & (F.col(prep) > 0), needed).otherwise(F.lit(0.0))


def station_status(orders: DataFrame, stations: DataFrame, as_of: When, lookback: str = "10m") -> DataFrame:
    """Live state of every station in the reference table, busiest first."""
    active = stations.join(station_load(orders, as_of, lookback), "station_id", "left").withColumn(
        "active_orders", F.coalesce("active_orders", F.lit(0))
    )
    measured = active.withColumn(
        "queue_size", F.greatest(F.lit(0), F.col("active_orders") - F.col("max_capacity"))
    ).withColumns({"load_pct": load_pct("active_orders"), "drain_minutes": drain_minutes(F.col("queue_size"))})
    pct = F.col("load_pct")
    return (
        measured.withColumns(
            {
                "station_status": F.when(pct >= 100, "saturated")
                .when(pct >= 75, "busy")
                .when(F.col("active_orders") > 0, "active")
                .otherwise("idle"),
                "severity": F.when(pct >= 100, "critical").when(pct >= 75, "warning").otherwise("info"),
            }
        )
        .select(
            "station_id",
            "display_name",
            "specialization",
            "station_status",
            "active_orders",
            "queue_size",
            "max_capacity",
            "load_pct",
            "drain_minutes",
            "severity",
        )
        .orderBy(pct.desc(), "station_id")
    )


def station_pressure(orders: DataFrame, as_of: When, lookback: str = "1h", width: str = "5m") -> DataFrame:
    """Created, delayed and completed events per station and bucket; events without a station are left out."""
    steps = {"Created": ORDER_CREATED, "Delayed": ORDER_DELAYED, "Completed": ORDER_PAID}
    counts = [F.count_if(F.col("event_name") == name).alias(label) for label, name in steps.items()]
    window = recent(orders, as_of, lookback, strict=True).where(not_blank("station_id"))
    return bucketed(window, width, ["station_id"], *counts).orderBy("event_time", "station_id")


def critical_inventory_last(inventory: DataFrame) -> DataFrame:
    """The newest critical reading per ingredient, even if stock has recovered since."""
    return (
        latest_by(low_stock(inventory), "ingredient_id")
        .orderBy("stock_pct", "ingredient_id")
        .select("event_time", "ingredient_id", "stock_pct", "threshold_pct", "severity")
    )


def newest_decisions(
    agent: DataFrame, approval: DataFrame, action: DataFrame, as_of: When | None = None, top: int = 100,
    lookback: str | None = None,
) -> DataFrame:
    """The newest entries of the decision trace up to `as_of`, at most `lookback` old if that is given."""
    return decision_trace(*(until(df, as_of, lookback) for df in (agent, approval, action)), top=top)
