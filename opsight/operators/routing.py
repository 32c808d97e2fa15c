"""Raw events to the six operational tables: filters and projections of one row, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.functions import as_double, as_int, as_long, has_prefix, payload_fields, text, with_zeros
from opsight.schemas import (
    ACTION,
    ACTION_PREFIX,
    AGENT,
    AGENT_PREFIX,
    APPROVAL,
    APPROVAL_PREFIX,
    INVENTORY,
    INVENTORY_CHANGED,
    KITCHEN,
    KITCHEN_UPDATED,
    ORDER_EVENT_NAMES,
    ORDERS,
    RAW,
)
from opsight.sources.manifest import new_stamp, publish_load
from opsight.sources.tables import read_files, write_files

# Which event names belong to which table: equality is exact, prefixes ignore case. Names that match none stay in raw.
_BELONGS: dict[str, Callable[[], Column]] = {
    ORDERS: lambda: F.col("event_name").isin(*ORDER_EVENT_NAMES),
    KITCHEN: lambda: F.col("event_name") == KITCHEN_UPDATED,
    INVENTORY: lambda: F.col("event_name") == INVENTORY_CHANGED,
    AGENT: lambda: has_prefix("event_name", AGENT_PREFIX),
    APPROVAL: lambda: has_prefix("event_name", APPROVAL_PREFIX),
    ACTION: lambda: has_prefix("event_name", ACTION_PREFIX),
}


def _routed(raw: DataFrame, target: str, *columns: Column | str) -> DataFrame:
    """Rows of one target with event_time and event_id first, severity and payload last.

    `event_date` is passed on when raw comes from a stored table, so that later time filters still prune days.
    """
    day = ["event_date"] if "event_date" in raw.columns else []
    tail = [text("severity").alias("severity"), "payload"]
    return raw.where(_BELONGS[target]()).select(
        "event_time", text("event_id").alias("event_id"), *columns, *tail, *day
    )


def _strings(*names: str) -> list[Column]:
    return [text(n).alias(n) for n in names]


def route_orders(raw: DataFrame) -> DataFrame:
    status, delay = payload_fields("order_status", "delay_minutes")
    return _routed(
        raw,
        ORDERS,
        *_strings("order_id", "channel"),
        "event_name",
        text(status).alias("order_status"),
        *_strings("station_id"),
        as_double(delay).alias("delay_minutes"),
    )


def route_kitchen(raw: DataFrame) -> DataFrame:
    (capacity,) = payload_fields("capacity")
    return _routed(raw, KITCHEN, *_strings("station_id"), as_long(capacity).alias("capacity"))


def route_inventory(raw: DataFrame) -> DataFrame:
    """Every use of this table tests its two numbers. They come from a generator, which filters on them stay above, so
    a reading is parsed once and not again for the filter."""
    day = ["event_date"] if "event_date" in raw.columns else []
    parsed = raw.where(_BELONGS[INVENTORY]()).select(
        "event_time",
        "event_id",
        "ingredient_id",
        "severity",
        "payload",
        *day,
        F.json_tuple("payload", "stock_pct", "threshold_pct").alias("stock_pct", "threshold_pct"),
    )
    return parsed.select(
        "event_time",
        *_strings("event_id", "ingredient_id"),
        as_double("stock_pct").alias("stock_pct"),
        as_double("threshold_pct").alias("threshold_pct"),
        *_strings("severity"),
        "payload",
        *day,
    )


def route_agent(raw: DataFrame, *also: str) -> DataFrame:
    recommendation, priority, confidence = payload_fields("recommendation_id", "priority", "confidence")
    return _routed(
        raw,
        AGENT,
        text(recommendation).alias("recommendation_id"),
        *_strings("order_id"),
        as_int(priority).alias("priority"),
        as_double(confidence).alias("confidence"),
        *also,
    )


def route_approval(raw: DataFrame, *also: str) -> DataFrame:
    recommendation, approver, status = payload_fields("recommendation_id", "approver", "approval_status")
    return _routed(
        raw,
        APPROVAL,
        text(recommendation).alias("recommendation_id"),
        text(approver).alias("approver"),
        text(status).alias("approval_status"),
        *also,
    )


def route_action(raw: DataFrame) -> DataFrame:
    action, status = payload_fields("action_id", "action_status")
    return _routed(
        raw,
        ACTION,
        text(action).alias("action_id"),
        F.col("event_name").alias("action_type"),
        text(status).alias("action_status"),
    )


def with_event_name(tables, name: str) -> DataFrame:
    """A table with the names of its events; tables that hold several kinds without naming them are routed again."""
    if name == AGENT:
        return route_agent(tables.raw, "event_name")
    if name == APPROVAL:
        return route_approval(tables.raw, "event_name")
    rows, single = tables.by_name(name), {KITCHEN: KITCHEN_UPDATED, INVENTORY: INVENTORY_CHANGED}
    if name in single:
        return rows.withColumn("event_name", F.lit(single[name]))
    return rows.withColumn("event_name", F.col("action_type")) if name == ACTION else rows


ROUTES: dict[str, Callable[[DataFrame], DataFrame]] = {
    ORDERS: route_orders,
    KITCHEN: route_kitchen,
    INVENTORY: route_inventory,
    AGENT: route_agent,
    APPROVAL: route_approval,
    ACTION: route_action,
}


def route_counts(raw: DataFrame) -> DataFrame:
    """Rows per target table; `unrouted` are the events that stay in raw only. Always one row for each."""
    target = F.lit("unrouted")
    for name in reversed(ROUTES):
        target = F.when(_BELONGS[name](), F.lit(name)).otherwise(target)
    counts = raw.groupBy(target.alias("target")).agg(F.count("*").alias("rows"))
    return with_zeros(counts, "target", [*ROUTES, "unrouted"], "rows")


def fan_out(
    raw: DataFrame,
    root: str,
    batch_id: str | int,
    *,
    rebalance: bool = True,
    from_storage: bool = False,
    also: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> None:
    """Write one batch into raw and all six targets, and what `also` makes of it for other tables along with it.

    The batch is evaluated once. Micro-batches are kept for the seven writes; with `from_storage`, for large loads, the
    targets are routed from the raw files just written, which needs no room on the executors and survives their loss.
    The six routed writes are independent jobs and run side by side. All tables are published by one record, so
    readers see the whole batch or nothing of it, and running it again after a failure part-way, or after a success,
    gives each table exactly one copy.
    """
    spark, stamp = raw.sparkSession, new_stamp()

    def write(name: str, rows: DataFrame) -> dict[str, list[int]]:
        return write_files(rows, root, name, batch_id, stamp, rebalance=rebalance)

    source = raw if from_storage else raw.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        written = {RAW: write(RAW, source)}
        landed = read_files(spark, root, RAW, batch_id, stamp, written[RAW]) if from_storage else source
        with ThreadPoolExecutor(len(ROUTES)) as pool:
            run = inheritable_thread_target(spark)(write)
            jobs = {name: pool.submit(run, name, route(landed)) for name, route in (ROUTES | (also or {})).items()}
        written |= {name: job.result() for name, job in jobs.items()}
        publish_load(spark, root, str(batch_id), stamp, written)
    finally:
        if not from_storage:
            source.unpersist()
