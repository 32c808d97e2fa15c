"""Troubleshooting queries over the event history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.functions import as_long, bucketed, payload_fields
from opsight.schemas import ORDER_DELAYED, SENTIMENT

# --- fixed values: default thresholds ---
MIN_DELAY = 5
MIN_QUEUE = 7
MIN_AVG_QUEUE = 6
REVIEW_DELAY = 8
# ----------------------------------------

_FAN_OUT_CHUNKS = 256


def newest_first(df: DataFrame, time: str = "event_time", *ties: str) -> DataFrame:
    """Total order; the tie columns also let the range partitioning cut a run of equal times.

    A global order costs a range shuffle and a sampling pass. Bulk consumers of the same rows can take the unordered
    forms instead: `delayed_with_queue`, `low_stock`, the alert queries.
    """
    return df.orderBy(F.col(time).desc(), *[F.col(t).desc() for t in ties])


def raw_timeline(raw: DataFrame) -> DataFrame:
    """Raw events for reading, newest first."""
    shown = (
        "event_time",
        "event_name",
        "entity_type",
        "entity_id",
        "order_id",
        "station_id",
        "ingredient_id",
        "channel",
        "severity",
        "payload",
    )
    return newest_first(raw, "event_time", "event_id").select(*shown)


def delayed_with_queue(orders: DataFrame, min_delay: float = MIN_DELAY, min_queue: int = MIN_QUEUE) -> DataFrame:
    """Delay events of at least `min_delay` minutes behind a queue of at least `min_queue`; keeps event_id.

    The queue is tested above a generator, which the optimizer does not move it through: the payload is parsed once per
    delayed row instead of once in the filter and again in the projection.
    """
    late = orders.where((F.col("event_name") == ORDER_DELAYED) & (F.col("delay_minutes") >= min_delay))
    place = ("event_time", "event_id", "order_id", "channel", "station_id", "delay_minutes")
    return (
        late.select(*place, "severity", F.json_tuple("payload", "queue_size").alias("queue_size"))
        .withColumn("queue_size", as_long("queue_size"))
        .where(F.col("queue_size") >= min_queue)
        .select(*place, "queue_size", "severity")
    )


def delayed_high_queue(orders: DataFrame, min_delay: float = MIN_DELAY, min_queue: int = MIN_QUEUE) -> DataFrame:
    hits = delayed_with_queue(orders, min_delay, min_queue)
    return newest_first(hits, "event_time", "event_id").drop("event_id")


def low_stock(inventory: DataFrame) -> DataFrame:
    """Readings at or below their own threshold; keeps event_id."""
    return inventory.where(F.col("stock_pct") <= F.col("threshold_pct")).select(
        "event_time", "event_id", "ingredient_id", "stock_pct", "threshold_pct", "severity"
    )


def critical_inventory(inventory: DataFrame) -> DataFrame:
    return newest_first(low_stock(inventory), "event_time", "event_id").drop("event_id")


def station_saturation(
    kitchen: DataFrame, width: str = "5m", min_queue: int = MIN_QUEUE, min_avg: float = MIN_AVG_QUEUE
) -> DataFrame:
    """Station buckets whose largest or mean reported queue is high."""
    (queue,) = payload_fields("queue_size")
    readings = kitchen.select("event_time", "station_id", as_long(queue).alias("queue_size"))
    load = bucketed(
        readings,
        width,
        ["station_id"],
        F.max("queue_size").alias("max_queue"),
        F.avg("queue_size").alias("avg_queue"),
        F.count("*").alias("events"),
    )
    hits = load.where((F.col("max_queue") >= min_queue) | (F.col("avg_queue") >= min_avg))
    return newest_first(hits, "event_time", "station_id").select(
        "station_id", "event_time", "max_queue", "avg_queue", "events"
    )


def negative_signals(orders: DataFrame) -> DataFrame:
    """Negative customer signals: event_time, event_id, order_id, reason; one parse per signal, as above."""
    return (
        orders.where(F.col("event_name") == SENTIMENT)
        .select(
            "event_time",
            "event_id",
            "order_id",
            F.json_tuple("payload", "sentiment", "reason").alias("sentiment", "reason"),
        )
        .where("sentiment = 'negative'")
        .drop("sentiment")
    )


def _delays_with_signal_counts(
    orders: DataFrame, signals: DataFrame, min_delay: float, min_queue: int, review_delay: float
) -> DataFrame:
    """Delayed orders to review, joined to `signals` (order_id, reason, copies)."""
    delayed = delayed_with_queue(orders, min_delay, min_queue).withColumnRenamed("event_time", "delay_time")
    return delayed.join(signals, "order_id", "left").where(
        F.col("copies").isNotNull() | (F.col("delay_minutes") >= review_delay)
    )


_REVIEW = ("delay_time", "order_id", "channel", "station_id", "delay_minutes", "queue_size")


def agent_review(
    orders: DataFrame,
    min_delay: float = MIN_DELAY,
    min_queue: int = MIN_QUEUE,
    review_delay: float = REVIEW_DELAY,
) -> DataFrame:
    """Delayed orders to review: those with a negative signal, or with a long delay.

    An order shows once per negative signal. Signals are counted per order before the join and multiplied out after
    it, so an order with very many signals sends a bounded number of rows through the shuffle; the counts are kept in
    chunks so that no single row has to hold them all. Where the repetition is not needed, `agent_review_counts` gives
    the same orders without it.
    """
    signals = (
        negative_signals(orders)
        .groupBy("order_id", "reason", F.pmod(F.xxhash64("event_id"), F.lit(_FAN_OUT_CHUNKS)).alias("chunk"))
        .agg(F.count("*").cast("int").alias("copies"))
        .drop("chunk")
    )
    repeated = F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1))))
    return newest_first(
        _delays_with_signal_counts(orders, signals, min_delay, min_queue, review_delay)
        .withColumn("copy", repeated)
        .select(*_REVIEW, F.when(F.col("copies").isNotNull(), F.lit("negative")).alias("sentiment"), "reason"),
        "delay_time",
        "order_id",
    )


def agent_review_counts(
    orders: DataFrame,
    min_delay: float = MIN_DELAY,
    min_queue: int = MIN_QUEUE,
    review_delay: float = REVIEW_DELAY,
) -> DataFrame:
    """`agent_review` with a count in place of repetition: one row per delay event and reason."""
    signals = negative_signals(orders).groupBy("order_id", "reason").agg(F.count("*").alias("copies"))
    return newest_first(
        _delays_with_signal_counts(orders, signals, min_delay, min_queue, review_delay).select(
            *_REVIEW, "reason", F.coalesce("copies", F.lit(0)).alias("negative_signals")
        ),
        "delay_time",
        "order_id",
    )


def _trace(agent: DataFrame, approval: DataFrame, action: DataFrame) -> DataFrame:
    blank = F.lit("")
    # fixed value: the label of recommendations in a trace
    recommended = F.lit("agent.recommendation.created")
    decided = F.concat(F.lit("approval."), "approval_status")

    def entries(df: DataFrame, name, entity: str, order) -> DataFrame:
        return df.select(
            "event_time",
            "event_id",
            name.alias("event_name"),
            F.col(entity).alias("entity_id"),
            order.alias("order_id"),
            "severity",
            "payload",
        )

    return (
        entries(agent, recommended, "recommendation_id", F.col("order_id"))
        .unionByName(entries(approval, decided, "recommendation_id", blank))
        .unionByName(entries(action, F.col("action_type"), "action_id", blank))
    )


def decision_trace(agent: DataFrame, approval: DataFrame, action: DataFrame, top: int | None = None) -> DataFrame:
    """Recommendations, decisions and actions in one list, newest first; `top` keeps the newest ones."""
    ordered = newest_first(_trace(agent, approval, action), "event_time", "event_id")
    return (ordered if top is None else ordered.limit(top)).drop("event_id")
