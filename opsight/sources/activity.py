"""Adapter from a generic activity log to raw operations events and to action requests.

The log has event_id, ts, user_id, event_type, value and props `{"k": 0..99}`; all fields of an event follow from
those. Everything is a projection of one row, so the adapter adds no shuffle and filters on `event_time` reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsight.schemas import (
    INVENTORY_CHANGED,
    KITCHEN_UPDATED,
    ORDER_CREATED,
    ORDER_DELAYED,
    ORDER_PAID,
    RAW_COLUMNS,
    SENTIMENT,
    layout,
)

ACTIVITY_SCHEMA = layout(
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)

# --- fixed values: domains of the event model ------------------------------------------------------------------------
STATION_IDS = ["grill", "fryer", "sauces", "assembly"]
CHANNELS = ["delivery", "dine-in", "takeout"]
INGREDIENTS = ["beef", "chicken", "fries", "sauce_bbq", "sauce_mayo"]
FEEDBACK = ["muy_negativo", "negativo", "neutral", "positivo"]
CANCELLATIONS = ["none", "cancelado_1_vez", "cancelado_2_veces", "cancelado_3_veces"]
APPROVERS = ["manager_on_duty", "shift_supervisor", "auto_approved"]
ACTION_EVENTS = [
    "action.reprioritize_order",
    "action.restock_ingredient",
    "action.reassign_station",
    "action.throttle_channel",
]
# ---------------------------------------------------------------------------------------------------------------------


def read_activity(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ACTIVITY_SCHEMA).parquet(f"{folder}/events.parquet")


def stream_activity(spark: SparkSession, folder: str) -> DataFrame:
    """The same log as a file stream; the bracket makes the path a pattern, which may also match a single file."""
    return spark.readStream.schema(ACTIVITY_SCHEMA).parquet(f"{folder}/events.parque[t]")


def _pick(values: list[str], index: str) -> str:
    """SQL for the value at a zero-based position."""
    return f"array({', '.join(repr(v) for v in values)})[CAST({index} AS INT)]"


def _json(**pairs: str) -> str:
    """SQL for JSON object text without spaces, keys in the given order; each value is SQL that yields JSON text."""
    parts = [f"""'{"," if i else "{"}"{key}":', {value}""" for i, (key, value) in enumerate(pairs.items())]
    return f"concat({', '.join(parts)}, '}}')"


def _quoted(value: str) -> str:
    return f"""'"', {value}, '"'"""


# Kinds of raw events in the order of their code, with the type of thing each is about.
_KINDS = [
    (ORDER_CREATED, "order"),
    (ORDER_DELAYED, "order"),
    (ORDER_PAID, "order"),
    (SENTIMENT, "order"),
    (KITCHEN_UPDATED, "station"),
    (INVENTORY_CHANGED, "ingredient"),
    ("agent.recommendation", "recommendation"),
    ("approval.decision", "recommendation"),
    *[(name, "action") for name in ACTION_EVENTS],
]
_CREATED, _DELAYED, _PAID, _SENTIMENT, _KITCHEN, _STOCK, _AGENT, _APPROVAL, _FIRST_ACTION = range(9)

_KIND = f"""CASE event_type
    WHEN 'signup' THEN {_CREATED}
    WHEN 'error' THEN {_DELAYED}
    WHEN 'purchase' THEN {_PAID}
    WHEN 'view' THEN IF(event_id % 2 = 0, {_KITCHEN}, {_STOCK})
    ELSE CASE event_id % 4 WHEN 0 THEN {_SENTIMENT} WHEN 1 THEN {_AGENT} WHEN 2 THEN {_APPROVAL}
         ELSE {_FIRST_ACTION} + (user_id div 12) % 4 END
  END"""

_CUSTOMER = {
    "is_premium": "IF(k % 5 = 0, 'true', 'false')",
    "cancellation_history": _quoted(_pick(CANCELLATIONS, "k % 4")),
    "feedback": _quoted(_pick(FEEDBACK, "(k div 4) % 4")),
    "sla_remaining": "k % 19",
}
_OUTCOME = {
    "action_id": _quoted("act"),
    "action_status": _quoted("IF(k % 10 = 0, 'failed', 'completed')"),
}
_PAYLOADS = {
    _CREATED: _json(order_status=_quoted("'created'"), **_CUSTOMER, items="1 + k % 4"),
    _DELAYED: _json(
        order_status=_quoted("'in_prep'"), delay_minutes="k % 13, '.0'", queue_size="k % 11", **_CUSTOMER
    ),
    _PAID: _json(order_status=_quoted("'completed'"), amount="k, '.5'", payment_method=_quoted("'card'")),
    _SENTIMENT: _json(
        sentiment=_quoted("IF(k % 2 = 0, 'negative', 'positive')"), reason=_quoted("'delivery_delay_risk'")
    ),
    _KITCHEN: _json(
        station_status=_quoted("IF(k % 3 = 0, 'saturated', 'normal')"), queue_size="k % 11", capacity="4 + k % 3"
    ),
    _STOCK: _json(stock_pct="k, '.0'", threshold_pct="IF(k % 2 = 0, '20.0', '15.0')", delta="'-2.5'"),
    _AGENT: _json(recommendation_id=_quoted("rec"), priority="1 + k % 5", confidence="'0.', 70 + k % 30"),
    _APPROVAL: _json(
        recommendation_id=_quoted("rec"),
        approver=_quoted(_pick(APPROVERS, "k % 3")),
        approval_status=_quoted("CASE k % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending' ELSE 'approved' END"),
    ),
}
_ACTION_PAYLOAD = f"""IF(k % 10 = 1, {_json(**_OUTCOME)}, {_json(**_OUTCOME, recommendation_id=_quoted("rec"))})"""


def raw_from_activity(log: DataFrame) -> DataFrame:
    payload = " ".join(f"WHEN {kind} THEN {text}" for kind, text in _PAYLOADS.items())
    columns = {
        "event_name": _pick([name for name, _ in _KINDS], "kind"),
        "entity_type": _pick([about for _, about in _KINDS], "kind"),
        "entity_id": f"""CASE WHEN kind <= {_SENTIMENT} THEN ord WHEN kind = {_KITCHEN} THEN station
            WHEN kind = {_STOCK} THEN ingredient WHEN kind <= {_APPROVAL} THEN rec ELSE act END""",
        "order_id": f"IF(kind IN ({_KITCHEN}, {_STOCK}), '', ord)",
        "station_id": f"IF(kind IN ({_STOCK}, {_SENTIMENT}), '', station)",
        "ingredient_id": f"IF(kind = {_STOCK}, ingredient, '')",
        "channel": f"IF(kind IN ({_KITCHEN}, {_STOCK}), '', {_pick(CHANNELS, 'u % 3')})",
        "severity": "CASE WHEN k < 50 THEN 'info' WHEN k < 85 THEN 'warning' ELSE 'critical' END",
        # declared never null, which spares a null test of the whole expression ahead of every other filter
        "payload": f"coalesce(CASE kind {payload} ELSE {_ACTION_PAYLOAD} END, '')",
    }
    return (
        log.selectExpr(
            "ts AS event_time",
            "event_id AS n",
            "user_id AS u",
            """CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k""",
            "date_format(ts, 'yyyyMMdd') AS d",
            f"{_KIND} AS kind",
        )
        .selectExpr(
            "*",
            "concat('ORD-', d, '-', u) AS ord",
            "concat('REC-', d, '-', u % 25) AS rec",
            "concat('ACT-', n) AS act",
            f"{_pick(STATION_IDS, '(u div 3) % 4')} AS station",
            f"{_pick(INGREDIENTS, 'u % 5')} AS ingredient",
        )
        .selectExpr("event_time", "concat('evt-', n) AS event_id", *[f"{sql} AS {c}" for c, sql in columns.items()])
        .select(*RAW_COLUMNS)
    )


_REQUEST = {
    "request_time": "ts",
    "request_id": "concat('req-', event_id)",
    "action": _pick(["ReprioritizeOrder", "TriggerRestock", "ThrottleChannel", "IssueCompensation"], "kind"),
    "orderId": "IF(kind IN (0, 3), IF(k % 17 = 0, '  ', concat(' ORD-', user_id)), NULL)",
    "stationId": f"IF(kind = 0, {_pick([*STATION_IDS, 'oven', ''], 'user_id % 6')}, NULL)",
    "priority": f"IF(kind = 0, {_pick(['normal', 'urgent', 'critical', 'later'], 'k % 4')}, NULL)",
    "reason": "IF(k % 13 <> 0, 'delivery_delay_risk', NULL)",
    "approvedBy": f"IF(kind = 0, {_pick(APPROVERS, 'k % 3')}, NULL)",
    "channel": f"IF(kind IN (0, 2) AND k % 7 <> 0, {_pick(CHANNELS, 'user_id % 3')}, NULL)",
    "severity": f"IF(kind IN (0, 1) AND k % 11 <> 0, {_pick(['info', 'warning', 'critical'], 'k % 3')}, NULL)",
    "ingredientId": f"IF(kind = 1, {_pick([*INGREDIENTS, 'tomato'], 'user_id % 6')}, NULL)",
    "stockPct": "IF(kind = 1, IF(k % 19 = 0, 'low', concat(k * 2, '.5')), NULL)",
    "durationMinutes": "IF(kind = 2, IF(k % 19 = 0, 'soon', CAST(k % 70 AS STRING)), NULL)",
    "compensationType": f"IF(kind = 3, {_pick(['discount', 'voucher', 'free_item', 'refund'], 'k % 4')}, NULL)",
    "recommendationId": "IF(k % 10 < 5, concat('REC-', user_id % 25), NULL)",
}


def requests_from_activity(log: DataFrame) -> DataFrame:
    """One action request per log row, some of them invalid on purpose; all values are text, as in a request body."""
    return log.selectExpr(
        "*", "event_id % 4 AS kind", """CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k"""
    ).selectExpr(*[f"{sql} AS {name}" for name, sql in _REQUEST.items()])
