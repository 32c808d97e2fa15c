"""Lifecycle checks and evidence reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.functions import has_prefix, instant, latest_by, lookup, recent, with_zeros
from opsight.operators.questions import decision_chains
from opsight.schemas import ACTION_PREFIX, ORDER_CREATED, ORDER_DELAYED, ORDER_PAID

When = str | dt.datetime

LIFECYCLE = (ORDER_CREATED, ORDER_DELAYED, ORDER_PAID)

# --- fixed values: the two names under which a reprioritization is recorded ---
REPRIORITIZE_EVENTS = ("action.kitchen.reprioritized", "action.reprioritize_order")
# ------------------------------------------------------------------------------


def _is(name: str):
    return F.col("event_name") == name


def lifecycle_violations(orders: DataFrame) -> DataFrame:
    """Orders that were not created exactly once, were delayed or paid twice, or had a step before creation."""
    per_order = (
        orders.where(F.col("event_name").isin(*LIFECYCLE))
        .groupBy("order_id")
        .agg(
            F.count_if(_is(ORDER_CREATED)).alias("created"),
            F.count_if(_is(ORDER_DELAYED)).alias("delayed"),
            F.count_if(_is(ORDER_PAID)).alias("paid"),
            F.min(F.when(_is(ORDER_CREATED), F.col("event_time"))).alias("first_created"),
            F.min(F.when(~_is(ORDER_CREATED), F.col("event_time"))).alias("first_other"),
        )
    )
    problems = F.concat_ws(
        ",",
        F.when(F.col("created") == 0, "not_created"),
        F.when(F.col("created") > 1, "created_again"),
        F.when(F.col("delayed") > 1, "delayed_again"),
        F.when(F.col("paid") > 1, "paid_again"),
        F.when(F.col("first_other") < F.col("first_created"), "step_before_created"),
    )
    return per_order.withColumn("problems", problems).where("problems <> ''")


def open_orders(orders: DataFrame, as_of: When) -> DataFrame:
    """Orders created or delayed and never paid up to `as_of`, with their age."""
    end = instant(orders, as_of)
    opened = F.when(~_is(ORDER_PAID), F.col("event_time"))
    per_order = (
        orders.where(F.col("event_name").isin(*LIFECYCLE) & (F.col("event_time") <= end))
        .groupBy("order_id")
        .agg(
            F.min(opened).alias("opened_at"),
            F.count_if(_is(ORDER_DELAYED)).alias("delays"),
            F.count_if(_is(ORDER_PAID)).alias("payments"),
        )
    )
    age = F.timestamp_diff("SECOND", F.col("opened_at").cast("timestamp"), end.cast("timestamp"))
    return per_order.where("payments = 0 and opened_at is not null").select(
        "order_id",
        "opened_at",
        F.when(F.col("delays") > 0, "delayed").otherwise("created").alias("state"),
        age.alias("age_seconds"),
    )


def state_summary(raw: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders per last lifecycle state, and raw events per name."""
    label = F.when(_is(ORDER_CREATED), "created").when(_is(ORDER_DELAYED), "delayed").otherwise("completed")
    steps = orders.where(F.col("event_name").isin(*LIFECYCLE)).select(
        "event_time", "event_id", "order_id", "event_name"
    )
    states = latest_by(steps, "order_id").groupBy(label.alias("name")).agg(F.count("*").alias("total"))
    names = raw.groupBy(F.col("event_name").alias("name")).agg(F.count("*").alias("total"))
    return states.select(F.lit("order_state").alias("kind"), "name", "total").unionByName(
        names.select(F.lit("event_name").alias("kind"), "name", "total")
    )


def shift_summary(raw: DataFrame, as_of: When, shift: str = "8h") -> DataFrame:
    """Result of a shift: completed on time, completed with delay, delays mitigated, actions carried out.

    A delay is mitigated when the order was reprioritized after its first delay and before its last payment.
    """
    events = recent(raw, as_of, shift)
    per_order = (
        events.where(F.col("event_name").isin(*LIFECYCLE))
        .groupBy("order_id")
        .agg(
            F.count_if(_is(ORDER_CREATED)).alias("created"),
            F.min(F.when(_is(ORDER_DELAYED), F.col("event_time"))).alias("first_delay"),
            F.max(F.when(_is(ORDER_PAID), F.col("event_time"))).alias("last_paid"),
        )
        .where("created > 0 and last_paid is not null")
    )
    completed = per_order.select(
        F.when(F.col("first_delay").isNull(), "completed_on_time").otherwise("completed_with_delay").alias("metric")
    )
    rescued = (
        lookup(
            events.where(F.col("event_name").isin(*REPRIORITIZE_EVENTS)).select("order_id", "event_time"),
            per_order.where("first_delay is not null"),
            "order_id",
            how="inner",
        )
        .where((F.col("event_time") > F.col("first_delay")) & (F.col("event_time") < F.col("last_paid")))
        .select("order_id")
        .distinct()
        .select(F.lit("delays_mitigated").alias("metric"))
    )
    acted = events.where(has_prefix("event_name", ACTION_PREFIX)).select(F.lit("actions_executed").alias("metric"))
    return with_zeros(
        completed.unionByName(rescued).unionByName(acted).groupBy("metric").agg(F.count("*").alias("total")),
        "metric",
        ["completed_on_time", "completed_with_delay", "delays_mitigated", "actions_executed"],
        "total",
    )


def chain_latency(
    agent: DataFrame, approval: DataFrame, action: DataFrame, as_of: When, lookback: str = "24h"
) -> DataFrame:
    """Seconds from recommendation to decision, decision to action and recommendation to action, per complete chain."""

    def seconds(start: str, end: str):
        begin, finish = F.col(start).cast("timestamp"), F.col(end).cast("timestamp")
        return F.timestamp_diff("MICROSECOND", begin, finish) / 1e6

    chains = decision_chains(agent, approval, action, as_of, lookback)
    return chains.where("appr_time is not null and act_time is not null").select(
        "recommendation_id",
        "rec_time",
        "appr_time",
        "act_time",
        seconds("rec_time", "appr_time").alias("decision_seconds"),
        seconds("appr_time", "act_time").alias("action_seconds"),
        seconds("rec_time", "act_time").alias("total_seconds"),
    )
