"""Column layouts of the landing table, the six operational tables and the station reference."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
}


def layout(columns: str) -> T.StructType:
    """`'name type, name type'` as a schema; needs no running session, so modules can declare layouts."""
    fields = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# --- fixed values: table names and columns -------------------------------------------------------------------------
RAW = "raw_restaurant_events"
ORDERS = "order_events"
KITCHEN = "kitchen_events"
INVENTORY = "inventory_events"
AGENT = "agent_events"
APPROVAL = "approval_events"
ACTION = "action_events"
STATIONS = "stations"

TABLE_SCHEMAS = {
    RAW: layout(
        "event_time timestamp, event_id string, event_name string, entity_type string, entity_id string, "
        "order_id string, station_id string, ingredient_id string, channel string, severity string, payload string"
    ),
    ORDERS: layout(
        "event_time timestamp, event_id string, order_id string, channel string, event_name string, "
        "order_status string, station_id string, delay_minutes double, severity string, payload string"
    ),
    KITCHEN: layout(
        "event_time timestamp, event_id string, station_id string, capacity bigint, severity string, payload string"
    ),
    INVENTORY: layout(
        "event_time timestamp, event_id string, ingredient_id string, stock_pct double, threshold_pct double, "
        "severity string, payload string"
    ),
    AGENT: layout(
        "event_time timestamp, event_id string, recommendation_id string, order_id string, priority int, "
        "confidence double, severity string, payload string"
    ),
    APPROVAL: layout(
        "event_time timestamp, event_id string, recommendation_id string, approver string, approval_status string, "
        "severity string, payload string"
    ),
    ACTION: layout(
        "event_time timestamp, event_id string, action_id string, action_type string, action_status string, "
        "severity string, payload string"
    ),
}
STATIONS_SCHEMA = layout(
    "station_id string, display_name string, specialization string, max_capacity bigint, avg_prep_minutes double, "
    "is_active boolean"
)

# --- fixed values: event names -------------------------------------------------------------------------------------
ORDER_CREATED = "order.created"
ORDER_DELAYED = "order.prep.delayed"
ORDER_PAID = "payment.completed"
SENTIMENT = "customer.sentiment.signal"
KITCHEN_UPDATED = "kitchen.station.updated"
INVENTORY_CHANGED = "inventory.level.changed"
ORDER_EVENT_NAMES = (ORDER_CREATED, ORDER_DELAYED, SENTIMENT, ORDER_PAID)
AGENT_PREFIX = "agent."
APPROVAL_PREFIX = "approval."
ACTION_PREFIX = "action."

# --- fixed values: order states that end an order ------------------------------------------------------------------
CLOSED_STATES = ("completed", "cancelled")
# -------------------------------------------------------------------------------------------------------------------

OPERATIONAL_TABLES = (ORDERS, KITCHEN, INVENTORY, AGENT, APPROVAL, ACTION)
EVENT_TABLES = (RAW, *OPERATIONAL_TABLES)
ORDER_STATES = "order_states"  # change log of the newest event per order; not an event table
TABLE_SCHEMAS[ORDER_STATES] = TABLE_SCHEMAS[ORDERS]
RAW_COLUMNS = TABLE_SCHEMAS[RAW].fieldNames()
QUARANTINE = "quarantined_lines"  # what the landing could not read; not an event table
TABLE_SCHEMAS[QUARANTINE] = layout("file string, line string")
RULE_HITS = "rule_hits"  # what polls of the rules have reported; not an event table
TABLE_SCHEMAS[RULE_HITS] = layout(
    "event_time timestamp, hit_id string, rule string, key string, occurrences bigint, action string, key_field string, "
    "source_event string"
)
ROLLUP = "minute_rollup"  # partial aggregates of raw; not an event table
TABLE_SCHEMAS[ROLLUP] = layout("event_time timestamp, event_name string, station_id string, events bigint, orders binary")
