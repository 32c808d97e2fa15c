"""Answers to the standing questions of the operations desk, evaluated at an explicit `as_of`."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.functions import (
    as_double,
    as_long,
    bucketed,
    is_open,
    latest_by,
    lookup,
    not_blank,
    or_default,
    payload_fields,
    recent,
    text,
)
from opsight.operators.dashboard import drain_minutes, load_pct, station_load

When = str | dt.datetime

_NAMES = ("station_id", "display_name", "specialization")


def _station_names(stations: DataFrame) -> DataFrame:
    return stations.select(*_NAMES)


def _last_states(orders: DataFrame, as_of: When, lookback: str) -> DataFrame:
    """Newest event per order within the window."""
    return latest_by(recent(orders, as_of, lookback), "order_id")


def sla_risk(orders: DataFrame, stations: DataFrame, as_of: When, lookback: str = "10m", top: int = 20) -> DataFrame:
    """Open orders most at risk of missing their agreed time.

    The key test runs before the newest-per-order step, where it removes the same rows but spares their shuffle; the
    station names are joined to the final `top` rows only.
    """
    (sla,) = payload_fields("sla_remaining")
    delay, left = F.col("delay_minutes"), F.col("sla_remaining")
    delay_score = F.when(delay >= 10, 3).when(delay >= 5, 2).otherwise(1)
    sla_score = F.when(left <= 5, 2).when(left <= 10, 1).otherwise(0)
    ranking = (F.col("risk_score").desc(), delay.desc(), left.asc(), F.col("order_id").asc())
    scored = (
        latest_by(recent(orders, as_of, lookback).where(not_blank("order_id")), "order_id")
        .where(is_open("order_status"))
        .withColumn("sla_remaining", as_double(sla))
        .withColumn("risk_score", (delay_score + sla_score).cast("bigint"))
    )
    return (
        scored.orderBy(*ranking)
        .limit(top)
        .join(_station_names(stations), "station_id", "left")
        .orderBy(*ranking)
        .select(
            "event_time",
            "order_id",
            "channel",
            *_NAMES,
            "delay_minutes",
            "sla_remaining",
            "risk_score",
            "order_status",
            "severity",
        )
    )


def kitchen_state(kitchen: DataFrame, as_of: When, lookback: str = "30m") -> DataFrame:
    """Newest reported state per station: station_id, station_status, reported_queue, severity."""
    status, queue = payload_fields("station_status", "queue_size")
    return latest_by(recent(kitchen, as_of, lookback), "station_id").select(
        "station_id", status.alias("station_status"), as_long(queue).alias("reported_queue"), "severity"
    )


def saturated_stations(
    orders: DataFrame,
    kitchen: DataFrame,
    stations: DataFrame,
    as_of: When,
    load_lookback: str = "10m",
    state_lookback: str = "30m",
) -> DataFrame:
    """Stations at 75 % load or more, or reported as saturated."""
    load = station_load(orders, as_of, load_lookback).withColumnRenamed("active_orders", "queue_size")
    state = kitchen_state(kitchen, as_of, state_lookback).drop("reported_queue")
    overflow = F.col("queue_size") - F.col("max_capacity")
    return (
        stations.join(load, "station_id", "left")
        .join(state, "station_id", "left")
        .withColumns(
            {
                "queue_size": F.coalesce("queue_size", F.lit(0)),
                "station_status": or_default("station_status", "idle"),
            }
        )
        .withColumns({"load_pct": load_pct("queue_size"), "drain_minutes": drain_minutes(overflow)})
        .where((F.col("load_pct") >= 75) | (F.col("station_status") == "saturated"))
        .orderBy(F.col("load_pct").desc(), F.col("queue_size").desc(), "station_id")
        .select(*_NAMES, "station_status", "queue_size", "max_capacity", "load_pct", "drain_minutes", "severity")
    )


def critical_now(inventory: DataFrame, as_of: When, lookback: str = "60m", floor_pct: float = 15) -> DataFrame:
    """Ingredients whose newest reading is at or below its threshold or the general floor."""
    stock = F.col("stock_pct")
    return (
        latest_by(recent(inventory, as_of, lookback), "ingredient_id")
        .where((stock <= F.col("threshold_pct")) | (stock <= floor_pct))
        .orderBy("stock_pct", "ingredient_id")
        .select("event_time", "ingredient_id", "stock_pct", "threshold_pct", "severity")
    )


def _last_decisions(approval: DataFrame, as_of: When, lookback: str) -> DataFrame:
    return latest_by(recent(approval, as_of, lookback), "recommendation_id").select(
        "recommendation_id", F.col("event_time").alias("appr_time"), "approver", "approval_status"
    )


def _last_recommendations(agent: DataFrame, as_of: When, lookback: str) -> DataFrame:
    return latest_by(recent(agent, as_of, lookback), "recommendation_id").select(
        "recommendation_id",
        F.col("event_time").alias("rec_time"),
        "order_id",
        "priority",
        "confidence",
        "severity",
    )


def _order_places(orders: DataFrame, as_of: When, lookback: str) -> DataFrame:
    return _last_states(orders, as_of, lookback).select("order_id", "station_id", "channel")


def pending_recommendations(
    agent: DataFrame, approval: DataFrame, orders: DataFrame, stations: DataFrame, as_of: When, lookback: str = "24h"
) -> DataFrame:
    """Recommendations whose newest decision is neither approved nor rejected, or that have none."""
    waiting = (
        _last_recommendations(agent, as_of, lookback)
        .join(_last_decisions(approval, as_of, lookback), "recommendation_id", "left")
        .where(~text("approval_status").isin("approved", "rejected"))
    )
    return (
        lookup(waiting, _order_places(orders, as_of, lookback), "order_id")
        .join(_station_names(stations), "station_id", "left")
        .orderBy(F.col("rec_time").desc(), "recommendation_id")
        .select(
            "recommendation_id", "order_id", "channel", *_NAMES, "priority", "confidence", "severity", "rec_time"
        )
    )


def decision_chains(
    agent: DataFrame, approval: DataFrame, action: DataFrame, as_of: When, lookback: str = "24h"
) -> DataFrame:
    """Newest recommendation, decision and action per recommendation id; the three sides share one partitioning."""
    (recommendation,) = payload_fields("recommendation_id")
    acted = (
        recent(action, as_of, lookback)
        .withColumn("recommendation_id", text(recommendation))
        .where("recommendation_id <> ''")
    )
    last_action = latest_by(acted, "recommendation_id").select(
        "recommendation_id", F.col("event_time").alias("act_time"), "action_id", "action_type", "action_status"
    )
    return (
        _last_recommendations(agent, as_of, lookback)
        .drop("severity")
        .join(_last_decisions(approval, as_of, lookback), "recommendation_id", "left")
        .join(last_action, "recommendation_id", "left")
    )


def full_trace(
    agent: DataFrame,
    approval: DataFrame,
    action: DataFrame,
    orders: DataFrame,
    stations: DataFrame,
    as_of: When,
    lookback: str = "24h",
) -> DataFrame:
    """Recommendation, decision, action, order and station in one row per recommendation."""
    return (
        lookup(
            decision_chains(agent, approval, action, as_of, lookback),
            _order_places(orders, as_of, lookback),
            "order_id",
        )
        .join(_station_names(stations), "station_id", "left")
        .orderBy(F.col("rec_time").desc(), "recommendation_id")
        .select(
            "recommendation_id",
            "order_id",
            "channel",
            *_NAMES,
            "priority",
            "confidence",
            "approval_status",
            "approver",
            "action_type",
            "action_status",
            "rec_time",
            "appr_time",
            "act_time",
        )
    )


def completed_by_station(
    orders: DataFrame, stations: DataFrame, as_of: When, lookback: str = "1h", width: str = "10m"
) -> DataFrame:
    """Completed events per station and bucket, newest bucket first."""
    done = recent(orders, as_of, lookback).where(F.col("order_status") == "completed")
    return (
        bucketed(done, width, ["station_id"], F.count("*").alias("completed"))
        .join(_station_names(stations), "station_id", "left")
        .orderBy(F.col("event_time").desc(), F.col("completed").desc(), "station_id")
        .select("event_time", *_NAMES, "completed")
    )


def active_by_station(orders: DataFrame, stations: DataFrame, as_of: When, lookback: str = "10m") -> DataFrame:
    """Open orders per station of their newest event."""
    return (
        _last_states(orders, as_of, lookback)
        .where(is_open("order_status"))
        .groupBy("station_id")
        .agg(F.count("*").alias("queue_size"))
        .join(_station_names(stations), "station_id", "left")
        .orderBy(F.col("queue_size").desc(), "station_id")
        .select(*_NAMES, "queue_size")
    )


def active_count(orders: DataFrame, as_of: When, lookback: str = "10m") -> DataFrame:
    """Number of open orders by newest event."""
    return _last_states(orders, as_of, lookback).where(is_open("order_status")).agg(F.count("*").alias("Count"))
