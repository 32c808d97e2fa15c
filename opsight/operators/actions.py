"""Action requests, their contracts, and the approval gate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.functions import as_double, instant, lookup, payload_fields, text
from opsight.schemas import RAW_COLUMNS

# --- fixed values: action contracts (parameter -> type, allowed values, range) ---------------------------------------
_STATIONS = ("grill", "fryer", "sauces", "assembly")
_CHANNELS = ("delivery", "dine-in", "takeout")
CONTRACTS = {
    "ReprioritizeOrder": {
        "orderId": {"type": "string"},
        "stationId": {"type": "string", "enum": _STATIONS},
        "priority": {"type": "string", "enum": ("normal", "urgent", "critical")},
        "reason": {"type": "string"},
        "approvedBy": {"type": "string"},
        "channel": {"type": "string", "enum": _CHANNELS},
        "severity": {"type": "string", "enum": ("info", "warning", "critical")},
    },
    "TriggerRestock": {
        "ingredientId": {"type": "string", "enum": ("beef", "chicken", "fries", "sauce_bbq", "sauce_mayo")},
        "stockPct": {"type": "number", "range": (0, 100)},
        "reason": {"type": "string"},
        "severity": {"type": "string", "enum": ("warning", "critical")},
    },
    "ThrottleChannel": {
        "channel": {"type": "string", "enum": _CHANNELS},
        "durationMinutes": {"type": "integer", "range": (1, 60)},
        "reason": {"type": "string"},
    },
    "IssueCompensation": {
        "orderId": {"type": "string"},
        "compensationType": {"type": "string", "enum": ("discount", "voucher", "free_item")},
        "reason": {"type": "string"},
    },
}

# --- fixed values: the event of an approved reprioritization, and its defaults ---------------------------------------
REPRIORITIZED = "action.kitchen.reprioritized"
DEFAULT_CHANNEL = "delivery"
DEFAULT_SEVERITY = "warning"
APPROVED = "approved"
# ---------------------------------------------------------------------------------------------------------------------


def given(requests: DataFrame, name: str) -> Column:
    """A request value as trimmed text, blank when missing."""
    if name not in requests.columns:
        return F.lit("")
    return F.trim(text(F.col(name).cast("string")))


def _parameter_error(requests: DataFrame, name: str, rule: dict) -> Column:
    """`<name>:<what is wrong>` or null; all parameters of a contract are required."""
    value = given(requests, name)
    checks = F.when(value == "", F.lit(f"{name}:required"))
    if "enum" in rule:
        checks = checks.when(~value.isin(*rule["enum"]), F.lit(f"{name}:enum"))
    if rule["type"] == "integer":
        checks = checks.when(value.try_cast("int").isNull(), F.lit(f"{name}:type"))
    if rule["type"] == "number":
        checks = checks.when(as_double(value).isNull(), F.lit(f"{name}:type"))
    if "range" in rule:
        low, high = rule["range"]
        checks = checks.when(~as_double(value).between(low, high), F.lit(f"{name}:range"))
    return checks


def validate_requests(requests: DataFrame, contracts: dict[str, dict] = CONTRACTS) -> DataFrame:
    """Every request with `valid` and its errors (`parameter:problem`, joined by `;`)."""
    errors = F.lit("action:unknown")
    for action, parameters in contracts.items():
        found = F.concat_ws(";", *[_parameter_error(requests, name, rule) for name, rule in parameters.items()])
        errors = F.when(F.col("action") == action, found).otherwise(errors)
    return requests.withColumn("errors", errors).withColumn("valid", F.col("errors") == "")


def action_events(requests: DataFrame, as_of: str | dt.datetime | None = None) -> DataFrame:
    """Approved reprioritization requests as action events in the raw layout.

    Order and station are required after trimming; requests without them give no event. Event time is the request's
    own, or `as_of`. Identifiers follow from the request, so sending it again gives the same event. A recommendation
    id is carried along when the request has one.
    """
    when = F.col("request_time") if as_of is None else instant(requests, as_of, "request_time")
    order_id, station_id = given(requests, "orderId"), given(requests, "stationId")
    digest = F.substring(F.sha2(F.concat_ws("|", "request_id", order_id, station_id), 256), 1, 32)
    action_id = F.concat(F.lit("act-"), digest)
    recommendation = (
        F.nullif(given(requests, "recommendationId"), F.lit(""))
        if "recommendationId" in requests.columns
        else F.lit(None).cast("string")
    )
    payload = F.to_json(
        F.struct(
            action_id.alias("action_id"),
            F.lit(APPROVED).alias("action_status"),
            text("priority").alias("priority"),
            text("reason").alias("reason"),
            text("approvedBy").alias("approved_by"),
            recommendation.alias("recommendation_id"),
        )
    )
    accepted = requests.where((F.col("action") == "ReprioritizeOrder") & (order_id != "") & (station_id != ""))
    return accepted.select(
        when.alias("event_time"),
        F.concat(F.lit("evt-"), digest).alias("event_id"),
        F.lit(REPRIORITIZED).alias("event_name"),
        F.lit("action").alias("entity_type"),
        action_id.alias("entity_id"),
        order_id.alias("order_id"),
        station_id.alias("station_id"),
        F.lit("").alias("ingredient_id"),
        F.coalesce("channel", F.lit(DEFAULT_CHANNEL)).alias("channel"),
        F.coalesce("severity", F.lit(DEFAULT_SEVERITY)).alias("severity"),
        payload.alias("payload"),
    ).select(*RAW_COLUMNS)


def ungated_actions(action: DataFrame, approval: DataFrame) -> DataFrame:
    """Actions without an approved decision on the same recommendation at or before their time."""
    (recommendation,) = payload_fields("recommendation_id")
    first_approved = (
        approval.where((F.col("approval_status") == APPROVED) & (F.col("recommendation_id") != ""))
        .groupBy("recommendation_id")
        .agg(F.min("event_time").alias("first_approved"))
    )
    acted = action.select(
        "event_time",
        "event_id",
        "action_id",
        "action_type",
        "action_status",
        text(recommendation).alias("recommendation_id"),
    )
    # most actions may name no recommendation: nothing can match those, so they go past the join instead of to one key
    named = lookup(acted.where("recommendation_id <> ''"), first_approved, "recommendation_id").where(
        F.col("first_approved").isNull() | (F.col("first_approved") > F.col("event_time"))
    )
    nameless = acted.where("recommendation_id = ''").withColumn("first_approved", F.lit(None).cast("timestamp"))
    return named.unionByName(nameless)
