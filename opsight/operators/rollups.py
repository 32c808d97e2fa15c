"""Dashboards from partial aggregates: one row a minute, event name and station instead of the events.

The rows are written and published with the load they count (`fan_out(..., also=...)`), so a corrected load takes its
old counts along, and refreshing a dashboard reads no event. Distinct orders are kept as sketches that can be united
over any minutes, stations and loads; an order in several of them counts once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.functions import bucketed, instant, not_blank, span, start_of_day, text
from opsight.functions.timebox import moment
from opsight.schemas import ORDER_CREATED, ORDER_DELAYED, ORDER_PAID, SENTIMENT

When = str | dt.datetime

SKETCH_BITS = 12  # 4,096 registers: a relative error of about 1.6 % (one standard deviation)


def minute_rollup(raw: DataFrame) -> DataFrame:
    """Events and a sketch of their orders by minute, event name and station (blank: none)."""
    orders = F.hll_sketch_agg(F.when(not_blank("order_id"), F.col("order_id")), F.lit(SKETCH_BITS))
    named = raw.withColumn("station_id", text("station_id"))
    return bucketed(named, "1m", ["event_name", "station_id"], F.count("*").alias("events"), orders.alias("orders"))


def _minutes(rollup: DataFrame, start: dt.datetime, as_of: When) -> DataFrame:
    """Whole minutes that start in [start, as_of)."""
    end = moment(as_of)
    kept = rollup.where((F.col("event_time") >= instant(rollup, start)) & (F.col("event_time") < instant(rollup, end)))
    return kept.where(F.col("event_date").between(F.lit(start.date()), F.lit(end.date()))) if "event_date" in rollup.columns else kept


def throughput(rollup: DataFrame, width: str = "1m") -> DataFrame:
    """Events per bucket of whole minutes and event name, oldest first."""
    return bucketed(rollup, width, ["event_name"], F.sum("events").alias("Events")).orderBy("event_time", "event_name")


def station_pressure(rollup: DataFrame, as_of: When, lookback: str = "1h", width: str = "5m") -> DataFrame:
    """Created, delayed and completed events per station and bucket over the whole minutes of the range; events without
    a station are left out."""
    steps = {"Created": ORDER_CREATED, "Delayed": ORDER_DELAYED, "Completed": ORDER_PAID}
    counts = [F.sum(F.when(F.col("event_name") == name, F.col("events")).otherwise(0)).alias(label) for label, name in steps.items()]
    window = _minutes(rollup, moment(as_of) - span(lookback), as_of)
    lifecycle = window.where(F.col("event_name").isin(*steps.values(), SENTIMENT) & not_blank("station_id"))
    return bucketed(lifecycle, width, ["station_id"], *counts).orderBy("event_time", "station_id")


def distinct_orders(rollup: DataFrame, *keys: str) -> DataFrame:
    """Estimated number of distinct orders per key, from united sketches."""
    united = F.hll_sketch_estimate(F.hll_union_agg("orders"))
    return rollup.groupBy(*keys).agg(united.alias("Total"))


def orders_today(rollup: DataFrame, as_of: When) -> DataFrame:
    """Estimated number of distinct orders created since the start of the day, in whole minutes."""
    return distinct_orders(_minutes(rollup, start_of_day(as_of), as_of).where(F.col("event_name") == ORDER_CREATED))
