"""The default rules as data, and reading of rule files with the same field names.

A rule names its source table and event, a list of conditions that must all hold (`field` against `value` or another
`fieldRef`; `payload.x` reads a payload key), optionally a tumbling `window` with `minimumOccurrences` per key, the
`keyField` its hits are about, and the action event it leads to.
"""

from __future__ import annotations

import json
from pathlib import Path

# --- fixed values: rule names, conditions, action events -------------------------------------------------------------
DEFAULT_RULES = [
    {
        "name": "DelayedOrderHighQueue",
        "source": {"table": "order_events", "eventName": "order.prep.delayed"},
        "keyField": "order_id",
        "condition": {
            "all": [
                {"field": "delay_minutes", "operator": ">=", "value": 5},
                {"field": "payload.queue_size", "operator": ">=", "value": 7},
            ]
        },
        "action": {"eventName": "action.kitchen.reprioritized"},
    },
    {
        "name": "CriticalInventory",
        "source": {"table": "inventory_events", "eventName": "inventory.level.changed"},
        "keyField": "ingredient_id",
        "condition": {"all": [{"field": "stock_pct", "operator": "<=", "fieldRef": "threshold_pct"}]},
        "action": {"eventName": "action.restock.triggered"},
    },
    {
        "name": "DeliveryChannelSaturation",
        "source": {"table": "order_events", "eventName": "order.prep.delayed"},
        "keyField": "channel",
        "condition": {
            "all": [
                {"field": "channel", "operator": "==", "value": "delivery"},
                {"field": "delay_minutes", "operator": ">=", "value": 5},
            ],
            "window": "5m",
            "minimumOccurrences": 3,
        },
        "action": {"eventName": "action.channel.throttled"},
    },
]

# --- fixed values: alert texts per rule (headline, message) ----------------------------------------------------------
ALERT_TEXTS = {
    "DelayedOrderHighQueue": (
        "Restaurant alert: delayed order with high queue",
        "A delayed order is waiting behind a high station queue. Review the station and reprioritize if needed.",
    ),
    "CriticalInventory": (
        "Restaurant alert: ingredient below threshold",
        "An ingredient has fallen below its threshold. Trigger replenishment or prepare substitutions.",
    ),
    "DeliveryChannelSaturation": (
        "Restaurant alert: delivery channel saturation",
        "Three or more delivery delays were detected in a five-minute window. Consider throttling delivery intake.",
    ),
}
# ---------------------------------------------------------------------------------------------------------------------


def _own(name: str, table: str, key: str, tests: list[tuple], event: str | None = None, window: str | None = None, least: int = 1) -> dict:
    """A rule of the larger example book; tests are (field, operator, value)."""
    condition: dict = {"all": [{"field": f, "operator": o, "value": v} for f, o, v in tests]}
    if window:
        condition |= {"window": window, "minimumOccurrences": least}
    source = {"table": table} | ({"eventName": event} if event else {})
    return {"name": name, "source": source, "keyField": key, "condition": condition, "action": {"eventName": f"action.review.{name}"}}


# a second book: rules on every table, by event name and without, with windows of different lengths
LARGER_RULES = [
    _own("LongDelay", "order_events", "order_id", [("delay_minutes", ">=", 10)], "order.prep.delayed"),
    _own("PremiumDelay", "order_events", "order_id", [("payload.is_premium", "==", True), ("delay_minutes", ">", 6)]),
    _own("UnhappyChannel", "order_events", "channel", [("payload.sentiment", "==", "negative")], "customer.sentiment.signal", "12h", 2),
    _own("BusyStation", "kitchen_events", "station_id", [("payload.queue_size", ">=", 8)], "kitchen.station.updated", "1d", 3),
    _own("SmallStation", "kitchen_events", "station_id", [("capacity", "<", 5), ("payload.station_status", "==", "saturated")]),
    _own("EmptyStock", "inventory_events", "ingredient_id", [("stock_pct", "<", 3)]),
    _own("UrgentAdvice", "agent_events", "recommendation_id", [("priority", "==", 1)], "agent.recommendation"),
    _own("OtherAdvice", "agent_events", "recommendation_id", [], "agent.other"),
    _own("Refused", "approval_events", "approver", [("approval_status", "==", "rejected")], "approval.decision", "1d", 2),
    _own("FailedThrottle", "action_events", "action_id", [("action_status", "==", "failed")], "action.throttle_channel"),
]


def load_rules(path: str) -> list[dict]:
    """Rules from a JSON file: a list, or an object with `rules`."""
    content = json.loads(Path(path).read_text(encoding="utf-8"))
    return content["rules"] if isinstance(content, dict) else content


def with_window(rules: list[dict], window: str) -> list[dict]:
    """The same rules with every windowed condition set to another window length."""
    return [
        {**r, "condition": {**r["condition"], "window": window}} if "window" in r["condition"] else r for r in rules
    ]
