"""All queries by name, over the tables of one data folder.

Each takes (spark, folder). Events of the folder are sparse, so look-back windows are wider here than the operators'
defaults; thresholds and limits are the defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.operators import actions, dashboard, loop, operational, quality, questions, rollups, routing, rules, signals
from opsight.plans.rulebook import DEFAULT_RULES, LARGER_RULES, with_window
from opsight.plans.tables import OpsTables
from opsight.schemas import ACTION, EVENT_TABLES, OPERATIONAL_TABLES, ORDER_CREATED, QUARANTINE, RAW, ROLLUP, TABLE_SCHEMAS
from opsight.session import prepare, scratch
from opsight.sources import events as event_source
from opsight.sources import stations as station_source
from opsight.sources import tables as store
from opsight.sources.activity import raw_from_activity, read_activity, requests_from_activity, stream_activity
from opsight.streaming import open_orders, routes, windows
from opsight.streaming import rules as streamed_rules
from opsight.streaming.runner import appended, rocksdb_state

AS_OF = "2024-01-30 18:00:00"
RETAIN_AS_OF = "2024-02-15 00:00:00"
LOAD = "6h"  # default 10m
STATE = "24h"  # default 30m
STOCK = "7d"  # default 60m
HOUR = "24h"  # default 1h
DAY = "7d"  # default 24h
BURST = "6h"  # default 5m, channel saturation only
SHIFT = "24h"  # default 8h
RULES = with_window(DEFAULT_RULES, BURST)

Query = Callable[[SparkSession, str], DataFrame]


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as in the source tables."""
    casts = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, T.TimestampType)}
    return df.withColumns(casts) if casts else df


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    return raw_from_activity(read_activity(prepare(spark), folder))


def ops_tables(spark: SparkSession, folder: str) -> OpsTables:
    return OpsTables.from_raw(raw_events(spark, folder))


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return requests_from_activity(read_activity(prepare(spark), folder))


def _raw_stream(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_from_activity(stream_activity(prepare(spark), folder))
    return raw.withColumn("event_time", F.col("event_time").cast("timestamp"))


def _on_tables(query: Callable[[OpsTables], DataFrame]) -> Query:
    return lambda spark, folder: _plain(query(ops_tables(spark, folder)))


def _on_stream(query: Callable[[DataFrame], DataFrame], label: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(appended(spark, query(_raw_stream(spark, folder)), scratch(spark, label)))

    return run


def _shared_columns(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """What stored tables have in common, with the name of the table."""
    parts = [
        store.read_table(spark, root, name).select(
            F.lit(name).alias("table_name"), "event_time", "event_id", "severity", "payload"
        )
        for name in names
    ]
    return _plain(reduce(DataFrame.unionByName, parts))


# --- sources, sinks, table maintenance ---


def _read_raw(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "json")
    event_source.write_json(raw_events(spark, folder), path)
    return _plain(event_source.read_raw(spark, path))


def _stream_raw(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "json")
    event_source.write_json(raw_events(spark, folder), path)
    return _plain(appended(spark, event_source.stream_raw(spark, path), scratch(spark, "landing")))


def _write_tables(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch(spark, "tables")
    routing.fan_out(raw_events(spark, folder), root, "load", from_storage=True)
    return _shared_columns(spark, root, EVENT_TABLES)


def _stations(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch(spark, "reference")
    station_source.write_stations(spark, root)
    station_source.write_stations(spark, root)
    events = raw_events(spark, folder).groupBy("station_id").agg(F.count("*").alias("events"))
    return station_source.read_stations(spark, root).join(events, "station_id", "left")


def _conform_schema(spark: SparkSession, folder: str) -> DataFrame:
    drifted = (
        raw_events(spark, folder)
        .drop("channel")
        .withColumns({"event_time": F.col("event_time").cast("string"), "stale": F.lit("x")})
    )
    return _plain(store.conform(drifted, TABLE_SCHEMAS[RAW]))


def _clear_tables(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch(spark, "clear")
    routing.fan_out(raw_events(spark, folder), root, "load", from_storage=True)
    station_source.write_stations(spark, root)
    store.stored_counts(spark, root).withColumnRenamed("rows", "rows_before").write.parquet(f"{root}/before")
    store.clear_tables(spark, root)
    after = store.stored_counts(spark, root).withColumnRenamed("rows", "rows_after")
    return spark.read.parquet(f"{root}/before").join(after, "table_name")


def _retention(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch(spark, "retention")
    store.write_table(raw_events(spark, folder), root, RAW, "load")
    store.expire(spark, root, RETAIN_AS_OF)
    return _plain(store.read_table(spark, root, RAW).drop("event_date"))


def _damaged_lines(raw: DataFrame) -> DataFrame:
    """Raw events as JSON lines of which some are broken off, some have no time and some an unreadable one."""
    number = F.col("event_id").substr(5, 20).cast("long")
    envelope = F.to_json(F.struct("event_id", "event_name", "entity_type", "entity_id", "order_id", "station_id", "ingredient_id", "channel", "severity"))
    head = F.expr("substring(envelope, 2, length(envelope) - 2)")
    stamp = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    time = (
        F.when(number % 83 == 0, F.lit(""))
        .when(number % 89 == 0, F.lit('"event_time":"soon",'))
        .otherwise(F.concat(F.lit('"event_time":"'), stamp, F.lit('",')))
    )
    line = F.concat(F.lit("{"), time, head, F.lit(',"payload":'), "payload", F.lit("}"))
    broken = F.when(number % 97 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    return raw.withColumn("envelope", envelope).select(broken.alias("value"))


def _quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of each line of a damaged landing, as a stream and in batch."""
    root, path = scratch(spark, "landing"), scratch(spark, "lines")
    _damaged_lines(raw_events(spark, folder)).write.text(path)
    routes.stream_landing(event_source.stream_parsed(spark, path), root, f"{root}/checkpoint").awaitTermination()
    identity = F.regexp_extract("line", '"event_id":"([^"]*)"', 1).alias("event_id")
    landed = F.lit("landed").alias("outcome")
    parts = {
        "stream": [
            store.read_table(spark, root, RAW).select("event_id", landed),
            store.read_table(spark, root, QUARANTINE).select(identity, F.col("reason").alias("outcome")),
        ],
        "batch": [
            event_source.read_raw(spark, path).select("event_id", landed),
            event_source.read_malformed(spark, path).select(identity, F.lit("rejected").alias("outcome")),
        ],
    }
    return reduce(DataFrame.unionByName, [p.withColumn("way", F.lit(way)) for way, both in parts.items() for p in both])


# --- routing ---


def _fan_out(spark: SparkSession, folder: str) -> DataFrame:
    """The same batch twice, as after a failure: each table still holds it once."""
    root = scratch(spark, "fanout")
    raw = raw_events(spark, folder)
    routing.fan_out(raw, root, 0)
    routing.fan_out(raw, root, 0)
    return _shared_columns(spark, root, OPERATIONAL_TABLES)


# --- dashboards from partial aggregates ---


def _rolled_up(query: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """A query on the stored rollup (and raw) after a first load of every other event was corrected."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        root, raw = scratch(spark, "rollup"), raw_events(spark, folder)
        for rows in (raw.where("CAST(substr(event_id, 5) AS long) % 2 = 0"), raw):
            routing.fan_out(rows, root, "load", also={ROLLUP: rollups.minute_rollup})
        return _plain(query(store.read_table(spark, root, ROLLUP), store.read_table(spark, root, RAW)))

    return run


def _sketch_error(rollup: DataFrame, raw: DataFrame) -> DataFrame:
    """Orders created by day, counted exactly, and whether the united sketches are within five standard errors."""
    created = F.col("event_name") == ORDER_CREATED
    estimated = rollups.distinct_orders(rollup.where(created), "event_date")
    exact = raw.where(created).groupBy("event_date").agg(F.count_distinct("order_id").alias("exact"))
    bound = F.col("exact") * 0.08 + 1
    near = F.abs(F.col("Total") - F.col("exact")) <= bound
    return exact.join(estimated, "event_date").select(F.col("event_date").alias("day"), "exact", near.alias("within_bound"))


# --- the loop on stored tables ---


def _action_loop(spark: SparkSession, folder: str) -> DataFrame:
    """Requests submitted twice: their events as they stand among the stored actions."""
    root = scratch(spark, "loop")
    routing.fan_out(raw_events(spark, folder), root, "load", from_storage=True)
    for load in ("requests", "requests-again"):
        loop.submit_requests(spark, root, _requests(spark, folder), load)
    done = store.read_table(spark, root, ACTION).where(F.col("action_type").isin(*loop.EVENT_OF.values()))
    return _plain(done.drop("event_date"))


def _polled_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Polls whose ranges overlap, one of them repeated: what has been reported in the end."""
    root = scratch(spark, "polls")
    routing.fan_out(raw_events(spark, folder), root, "load", from_storage=True)
    for as_of in ("2024-01-10", "2024-01-20", "2024-01-20", "2024-02-01"):
        loop.poll_rules(spark, root, as_of, LARGER_RULES, late="2d", first="10d")
    return _plain(loop.reported_hits(spark, root).drop("hit_id", "key_field"))


# --- streaming ---


def _stream_route(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch(spark, "routed")
    routes.stream_route(_raw_stream(spark, folder), root, f"{root}/checkpoint").awaitTermination()
    return _shared_columns(spark, root, OPERATIONAL_TABLES)


def _stream_latest_order(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch(spark, "states")
    orders = routing.route_orders(_raw_stream(spark, folder))
    routes.stream_order_states(orders, root, f"{root}/checkpoint").awaitTermination()
    return _plain(
        routes.current_orders(spark, root).select("order_id", "event_time", "event_id", "event_name", "order_status")
    )


def _stream_overdue(spark: SparkSession, folder: str) -> DataFrame:
    with rocksdb_state(spark):
        return _on_stream(lambda raw: open_orders.stream_overdue_orders(raw, LOAD), "overdue")(spark, folder)


def _stream_rules(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch(spark, "rules")
    streamed_rules.stream_rules(_raw_stream(spark, folder), root, f"{root}/checkpoint", lambda: LARGER_RULES).awaitTermination()
    return _plain(loop.reported_hits(spark, root).drop("hit_id", "key_field"))


def _hits(t: OpsTables) -> DataFrame:
    return rules.rule_hits(t, RULES)


# Queries over the set of tables; it makes no difference to them whether tables are derived or stored.
TABLE_QUERIES: dict[str, Callable[[OpsTables], DataFrame]] = {
    "R1_route_order": lambda t: t.orders,
    "R2_route_kitchen": lambda t: t.kitchen,
    "R3_route_inventory": lambda t: t.inventory,
    "R4_route_agent": lambda t: t.agent,
    "R5_route_approval": lambda t: t.approval,
    "R6_route_action": lambda t: t.action,
    "R7_route_counts": lambda t: routing.route_counts(t.raw),
    "O1_raw_timeline": lambda t: operational.raw_timeline(t.raw),
    "O2_delayed_high_queue": lambda t: operational.delayed_high_queue(t.orders),
    "O3_critical_inventory": lambda t: operational.critical_inventory(t.inventory),
    "O4_station_saturation": lambda t: operational.station_saturation(t.kitchen),
    "O5_agent_review": lambda t: operational.agent_review(t.orders),
    "O5_agent_review_counts": lambda t: operational.agent_review_counts(t.orders),
    "O6_trace_union": lambda t: operational.decision_trace(t.agent, t.approval, t.action),
    "D1_orders_today": lambda t: dashboard.orders_today(t.orders, AS_OF),
    "D2_active_orders": lambda t: dashboard.active_orders(t.orders, AS_OF),
    "D3_completed_today": lambda t: dashboard.completed_today(t.orders, AS_OF),
    "D4_completed_with_delay": lambda t: dashboard.completed_with_delay(t.orders, AS_OF),
    "D5_throughput": lambda t: dashboard.throughput(t.raw),
    "D6_delayed_orders": lambda t: dashboard.delayed_orders(t.orders, AS_OF, LOAD),
    "D7_station_status": lambda t: dashboard.station_status(t.orders, t.stations, AS_OF, LOAD),
    "D8_station_pressure": lambda t: dashboard.station_pressure(t.orders, AS_OF, HOUR),
    "D9_critical_inventory_last": lambda t: dashboard.critical_inventory_last(t.inventory),
    "D10_trace_top100": lambda t: dashboard.newest_decisions(t.agent, t.approval, t.action, AS_OF),
    "A1_delayed_high_queue": lambda t: rules.delayed_order_alerts(t.orders),
    "A2_critical_inventory": lambda t: rules.inventory_alerts(t.inventory),
    "A3_channel_saturation": lambda t: rules.channel_saturation(t.orders, BURST),
    "A3_channel_saturation_sliding": lambda t: rules.channel_saturation_sliding(t.orders, BURST),
    "A4_rules_from_config": lambda t: _hits(t).drop("key_field", "source_event"),
    "A4_larger_book": lambda t: rules.rule_hits(t, LARGER_RULES).drop("key_field"),
    "A4_rules_in_range": lambda t: rules.rule_hits(t, LARGER_RULES, AS_OF, DAY).drop("key_field", "source_event"),
    "A5_alert_actions": lambda t: rules.action_events_from_hits(_hits(t)),
    "A6_alert_messages": lambda t: rules.alert_messages(_hits(t)),
    "Q1_sla_risk": lambda t: questions.sla_risk(t.orders, t.stations, AS_OF, LOAD),
    "Q2_saturated_stations": lambda t: questions.saturated_stations(t.orders, t.kitchen, t.stations, AS_OF, LOAD, STATE),
    "Q3_critical_now": lambda t: questions.critical_now(t.inventory, AS_OF, STOCK),
    "Q4_pending_recommendations": lambda t: questions.pending_recommendations(
        t.agent, t.approval, t.orders, t.stations, AS_OF, DAY
    ),
    "Q5_full_trace": lambda t: questions.full_trace(t.agent, t.approval, t.action, t.orders, t.stations, AS_OF, DAY),
    "Q6_completed_by_station": lambda t: questions.completed_by_station(t.orders, t.stations, AS_OF, HOUR),
    "Q7_active_by_station": lambda t: questions.active_by_station(t.orders, t.stations, AS_OF, LOAD),
    "Q8_active_count": lambda t: questions.active_count(t.orders, AS_OF, LOAD),
    "C1_sla_risk_customer": lambda t: signals.sla_risk_with_customer_signal(t.orders),
    "C2_station_bottleneck": lambda t: signals.station_bottlenecks(
        t.orders, t.kitchen, t.inventory, t.stations, AS_OF, LOAD, STATE, STOCK
    ),
    "C3_signal_correlation": lambda t: signals.signal_correlation(
        t.orders, t.kitchen, t.inventory, t.stations, AS_OF, LOAD, STATE, STOCK, BURST
    ),
    "C4_delay_over_capacity": lambda t: signals.delay_over_capacity(t.orders, t.stations, AS_OF, LOAD),
    "C5_compensation": lambda t: signals.compensation_candidates(t.orders),
    "X3_human_gate": lambda t: actions.ungated_actions(t.action, t.approval),
    "L1_lifecycle_violations": lambda t: quality.lifecycle_violations(t.orders),
    "L2_open_orders": lambda t: quality.open_orders(t.orders, AS_OF),
    "L3_state_summary": lambda t: quality.state_summary(t.raw, t.orders),
    "L4_shift_summary": lambda t: quality.shift_summary(t.raw, AS_OF, SHIFT),
    "L5_rule_log": lambda t: rules.rule_log(t, RULES),
    "L5_larger_book": lambda t: rules.rule_log(t, LARGER_RULES),
    "L6_chain_latency": lambda t: quality.chain_latency(t.agent, t.approval, t.action, AS_OF, DAY),
}

_FOLDER_QUERIES: dict[str, Query] = {
    "S1_read_raw": _read_raw,
    "S2_stream_raw": _stream_raw,
    "S2_quarantine": _quarantine,
    "S3_write_tables": _write_tables,
    "S4_stations": _stations,
    "S5_conform_schema": _conform_schema,
    "S6_clear_tables": _clear_tables,
    "S7_retention": _retention,
    "R8_fan_out": _fan_out,
    "D1_distinct_sketch": _rolled_up(_sketch_error),
    "D5_throughput_rollup": _rolled_up(lambda rollup, raw: rollups.throughput(rollup)),
    "D8_station_pressure_rollup": _rolled_up(lambda rollup, raw: rollups.station_pressure(rollup, AS_OF, HOUR)),
    "A4_polled_rules": _polled_rules,
    "X1_action_loop": _action_loop,
    "X1_action_events": lambda spark, folder: actions.action_events(_requests(spark, folder)),
    "X2_validate_requests": lambda spark, folder: actions.validate_requests(_requests(spark, folder)).select(
        "request_id", "action", "valid", "errors"
    ),
    "T1_stream_route": _stream_route,
    "T2_stream_throughput": _on_stream(windows.stream_throughput, "throughput"),
    "T3_stream_saturation": _on_stream(windows.stream_saturation, "saturation"),
    "T4_stream_channel_saturation": _on_stream(
        lambda raw: windows.stream_channel_saturation(raw, BURST), "channels"
    ),
    "T5_stream_latest_order": _stream_latest_order,
    "T6_stream_delay_sentiment": _on_stream(lambda raw: windows.stream_delay_sentiment(raw, LOAD), "sentiment"),
    "T7_stream_alerts_once": _on_stream(windows.stream_alerts_once, "alerts"),
    "T8_stream_open_orders": _on_stream(lambda raw: windows.stream_open_orders(raw, LOAD), "open"),
    "T7_stream_rules": _stream_rules,
    "T8_stream_open_orders_timers": _stream_overdue,
}

QUERIES: dict[str, Query] = {**{name: _on_tables(query) for name, query in TABLE_QUERIES.items()}, **_FOLDER_QUERIES}
