"""Alert rules: the three standing ones, and rules declared as data."""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.functions import as_double, bucketed, span, text, until
from opsight.operators.operational import MIN_DELAY, MIN_QUEUE, delayed_with_queue, low_stock
from opsight.operators.routing import with_event_name
from opsight.plans.rulebook import ALERT_TEXTS, DEFAULT_RULES
from opsight.schemas import ORDER_DELAYED, RAW_COLUMNS

MIN_OCCURRENCES = 3

When = str | dt.datetime


def delayed_order_alerts(orders: DataFrame, min_delay: float = MIN_DELAY, min_queue: int = MIN_QUEUE) -> DataFrame:
    return delayed_with_queue(orders, min_delay, min_queue).drop("event_id")


def inventory_alerts(inventory: DataFrame) -> DataFrame:
    return low_stock(inventory).drop("event_id")


def _late_events(orders: DataFrame, channel: str | None, min_delay: float) -> DataFrame:
    late = orders.where((F.col("event_name") == ORDER_DELAYED) & (F.col("delay_minutes") >= min_delay))
    return late if channel is None else late.where(F.col("channel") == channel)


def channel_saturation(
    orders: DataFrame,
    width: str = "5m",
    channel: str | None = "delivery",
    min_delay: float = MIN_DELAY,
    min_count: int = MIN_OCCURRENCES,
) -> DataFrame:
    """Channel buckets with an accumulation of delays; `channel=None` looks at every channel."""
    counted = bucketed(
        _late_events(orders, channel, min_delay),
        width,
        ["channel"],
        F.count("*").alias("delayed_count"),
        F.max("delay_minutes").alias("max_delay"),
    )
    return counted.where(F.col("delayed_count") >= min_count).withColumn("severity", F.lit("warning"))


def channel_saturation_sliding(
    orders: DataFrame,
    width: str = "5m",
    channel: str | None = "delivery",
    min_delay: float = MIN_DELAY,
    min_count: int = MIN_OCCURRENCES,
) -> DataFrame:
    """The same rule over the trailing window at every second that has a delay, so bursts across a bucket edge count.

    Delays are first counted per channel and second. Each count then serves its own bucket and, as history, the next
    one, so a group holds at most two windows of seconds however many events there are and however much of the data one
    channel has. The trailing window is what the own bucket holds up to a second plus what the history holds from one
    window before it: two frames that only grow, hence linear work.
    """
    seconds = int(span(width).total_seconds())
    per_second = (
        _late_events(orders, channel, min_delay)
        .groupBy("channel", F.unix_seconds(F.col("event_time").cast("timestamp")).alias("second"))
        .agg(F.count("*").alias("n"), F.max("delay_minutes").alias("worst"))
        .withColumn("home", F.floor(F.col("second") / seconds))
        .withColumn("bucket", F.explode(F.array(F.col("home"), F.col("home") + 1)))
    )
    own = F.col("bucket") == F.col("home")
    group = W.partitionBy("channel", "bucket")
    until_now = group.orderBy("second").rowsBetween(W.unboundedPreceding, W.currentRow)
    since_start = group.orderBy(F.col("second").desc()).rangeBetween(W.unboundedPreceding, seconds - 1)

    def trailing(aggregate: Callable[[Column], Column], value: str) -> tuple[Column, Column]:
        here = aggregate(F.when(own, F.col(value))).over(until_now)
        before = aggregate(F.when(~own, F.col(value))).over(since_start)
        return here, before

    count_here, count_before = trailing(F.sum, "n")
    return (
        per_second.withColumns(
            {
                "delayed_count": count_here + F.coalesce(count_before, F.lit(0)),
                "max_delay": F.greatest(*trailing(F.max, "worst")),
            }
        )
        .where(own & (F.col("delayed_count") >= min_count))
        .select(
            F.timestamp_seconds("second").cast(orders.schema["event_time"].dataType).alias("event_time"),
            "channel",
            "delayed_count",
            "max_delay",
            F.lit("warning").alias("severity"),
        )
    )


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    ">=": operator.ge,
    "<=": operator.le,
    ">": operator.gt,
    "<": operator.lt,
    "==": operator.eq,
    "!=": operator.ne,
}
_PARSED = "_payload_"


def _payload_keys(rules: list[dict]) -> list[str]:
    tested = [t[k] for r in rules for t in r["condition"]["all"] for k in ("field", "fieldRef") if k in t]
    return sorted({f.removeprefix("payload.") for f in tested if f.startswith("payload.")})


def _with_payload(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Payload keys as text columns, from one parse a row: filters on what a generator makes stay above it."""
    plain = [k for k in keys if "." not in k and "[" not in k]
    if plain:
        rows = rows.select(*rows.columns, F.json_tuple("payload", *plain).alias(*[_PARSED + k for k in plain]))
    return rows.withColumns({_PARSED + k: F.get_json_object("payload", f"$.{k}") for k in keys if k not in plain})


def _operand(name: str, numeric: bool) -> Column:
    if not name.startswith("payload."):
        return F.col(name)
    value = F.col(f"`{_PARSED}{name.removeprefix('payload.')}`")
    return as_double(value) if numeric else text(value)


def _literal(value: bool | float | str) -> Column:
    """JSON writes truth values in lower case, and they arrive as text."""
    return F.lit(str(value).lower() if isinstance(value, bool) else value)


def rule_predicate(rule: dict, rows: DataFrame) -> Column:
    """All conditions of a rule as one predicate on `rows`. Text and truth values that are missing count as blank."""
    if "minimumOccurrences" in rule["condition"] and "window" not in rule["condition"]:
        raise ValueError(f"rule {rule['name']}: minimumOccurrences needs a window")
    numbers = {f.name for f in rows.schema if isinstance(f.dataType, T.NumericType)}
    combined = F.lit(True)
    for test in rule["condition"]["all"]:
        if test["operator"] not in _COMPARE:
            raise ValueError(f"rule {rule['name']}: unknown operator {test['operator']}")
        fields = [test[k] for k in ("field", "fieldRef") if k in test]
        value = test.get("value")
        ordered = test["operator"] not in ("==", "!=")
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        numeric = number or ("fieldRef" in test and (ordered or any(f in numbers for f in fields)))
        right = _operand(test["fieldRef"], numeric) if "fieldRef" in test else _literal(value)
        combined = combined & _COMPARE[test["operator"]](_operand(test["field"], numeric), right)
    return combined


def _by_source(tables, rules: list[dict], as_of: When | None, lookback: str | None) -> list[tuple[DataFrame, list[tuple[int, dict]]]]:
    """Each source table once, with the rules that look at it by number: their payload keys parsed, their event names
    and the time range as filters on the scan."""
    held: dict[str, list[tuple[int, dict]]] = {}
    for number, rule in enumerate(rules):
        held.setdefault(rule["source"]["table"], []).append((number, rule))
    out = []
    for table, numbered in held.items():
        names = [rule["source"].get("eventName") for _, rule in numbered]
        rows = until(with_event_name(tables, table) if any(names) else tables.by_name(table), as_of, lookback)
        if all(names):
            rows = rows.where(F.col("event_name").isin(sorted(set(names))))
        out.append((_with_payload(rows, _payload_keys([rule for _, rule in numbered])), numbered))
    return out


def _applies(rule: dict) -> Column:
    name = rule["source"].get("eventName")
    return F.col("event_name") == name if name else F.lit(True)


def _of_rule(values: list) -> Column:
    """The value of a row's rule, from a list with one for each rule."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("number") + 1)


def _widths(rules: list[dict], width: str | None = None) -> list[int]:
    """Window of each rule in microseconds; rules without one have `width`, or none (0)."""
    lengths = [rule["condition"].get("window", width) for rule in rules]
    return [int(span(w).total_seconds() * 1_000_000) if w else 0 for w in lengths]


def _bucket_start(rows: DataFrame, widths: list[int]) -> Column:
    kind, micros = rows.schema["event_time"].dataType, F.unix_micros(F.col("event_time").cast("timestamp"))
    width = _of_rule(widths)
    start = F.timestamp_micros(micros - F.pmod(micros, width)).cast(kind)
    return F.when(width > 0, start).otherwise(F.col("event_time"))


def rule_hits(tables, rules: list[dict] = DEFAULT_RULES, as_of: When | None = None, lookback: str | None = None) -> DataFrame:
    """All rules over their tables: rule, key, event_time, occurrences, action, the key's column and the event.

    Rules without a window give one hit per matching event; windowed rules one per key and bucket that reaches the
    minimum. However many rules there are, each source table is scanned once and its payload parsed once a row: a row
    is multiplied only by the rules it meets, and one aggregation counts for all of them. With `as_of` events up to it
    count, with `lookback` those since.
    """
    windowed = [bool(w) for w in _widths(rules)]
    parts = []
    for rows, numbered in _by_source(tables, rules, as_of, lookback):
        met = [
            F.when(
                _applies(rule) & rule_predicate(rule, rows),
                F.struct(F.lit(number).alias("number"), F.col(rule["keyField"]).cast("string").alias("key")),
            )
            for number, rule in numbered
        ]
        hit = rows.select("event_time", "event_id", F.explode(F.array_compact(F.array(*met))).alias("hit")).select("event_time", "event_id", "hit.*")
        source = F.when(_of_rule(windowed), F.lit("")).otherwise(F.col("event_id"))
        parts.append(hit.select("number", "key", _bucket_start(hit, _widths(rules)).alias("event_time"), source.alias("source_event")))
    counted = reduce(DataFrame.unionByName, parts).groupBy("number", "key", "event_time", "source_event").agg(F.count("*").alias("n"))
    least = _of_rule([rule["condition"].get("minimumOccurrences", 1) for rule in rules])
    # events that were delivered twice are hits twice; a bucket is one hit or none
    times = F.when(_of_rule(windowed), F.when(F.col("n") >= least, 1).otherwise(0)).otherwise(F.col("n"))
    return counted.select("*", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("each")).select(
        _of_rule([rule["name"] for rule in rules]).alias("rule"),
        "key",
        "event_time",
        F.when(_of_rule(windowed), F.col("n")).otherwise(1).cast("bigint").alias("occurrences"),
        _of_rule([rule["action"]["eventName"] for rule in rules]).alias("action"),
        _of_rule([rule["keyField"] for rule in rules]).alias("key_field"),
        "source_event",
    )


def hit_id(prefix: str) -> Column:
    """Identifier that depends on rule, key, instant and event only, so evaluating a rule again gives the same one."""
    stamp = F.unix_micros(F.col("event_time").cast("timestamp")).cast("string")
    cause = F.concat_ws("|", "rule", text("key"), stamp, text("source_event"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(cause, 256), 1, 32))


def action_events_from_hits(hits: DataFrame) -> DataFrame:
    """Hits as action events in the raw layout, ready to be appended and routed."""
    action_id = hit_id("act-")

    def about(column: str) -> Column:
        return F.when(F.col("key_field") == column, F.col("key")).otherwise("").alias(column)

    payload = F.to_json(
        F.struct(
            action_id.alias("action_id"),
            F.lit("triggered").alias("action_status"),
            F.col("action").alias("action_type"),
            F.col("rule").alias("rule"),
            F.when(F.col("key_field") == "recommendation_id", F.col("key")).alias("recommendation_id"),
        )
    )
    return hits.select(
        "event_time",
        hit_id("evt-").alias("event_id"),
        F.col("action").alias("event_name"),
        F.lit("action").alias("entity_type"),
        action_id.alias("entity_id"),
        about("order_id"),
        about("station_id"),
        about("ingredient_id"),
        about("channel"),
        F.lit("warning").alias("severity"),
        payload.alias("payload"),
    ).select(*RAW_COLUMNS)


def alert_messages(hits: DataFrame, texts: dict[str, tuple[str, str]] = ALERT_TEXTS) -> DataFrame:
    """Hits with headline and message of their rule. The texts are part of the plan: one small map per text."""

    def chosen(part: int) -> Column:
        pairs = [F.lit(v) for rule, both in texts.items() for v in (rule, both[part])]
        return F.create_map(*pairs)[F.col("rule")]

    return hits.select(
        "rule", "key", "event_time", chosen(0).alias("headline"), chosen(1).alias("message")
    )


def rule_log(
    tables, rules: list[dict] = DEFAULT_RULES, width: str = "5m", as_of: When | None = None, lookback: str | None = None
) -> DataFrame:
    """Per rule and time bucket: rows evaluated, rows that met the conditions, and hits.

    Windowed rules are logged at their own window; there a hit is a key that reaches the minimum. One scan for each
    source table, as in `rule_hits`.
    """
    windowed = [bool(w) for w in _widths(rules)]
    parts = []
    for rows, numbered in _by_source(tables, rules, as_of, lookback):
        looked_at = [
            F.when(
                _applies(rule),
                F.struct(
                    F.lit(number).alias("number"),
                    (F.col(rule["keyField"]).cast("string") if windowed[number] else F.lit(None).cast("string")).alias("key"),
                    F.coalesce(rule_predicate(rule, rows), F.lit(False)).alias("met"),
                ),
            )
            for number, rule in numbered
        ]
        seen = rows.select("event_time", F.explode(F.array_compact(F.array(*looked_at))).alias("seen")).select("event_time", "seen.*")
        parts.append(seen.select("number", "key", "met", _bucket_start(seen, _widths(rules, width)).alias("event_time")))
    counts = [F.count("*").alias("evaluated"), F.count_if("met").alias("matched")]
    counted = reduce(DataFrame.unionByName, parts).groupBy("number", "event_time", "key").agg(*counts)
    least = _of_rule([rule["condition"].get("minimumOccurrences", 1) for rule in rules])
    hits = F.when(_of_rule(windowed), (F.col("matched") >= least).cast("bigint")).otherwise(F.col("matched"))
    logged = counted.withColumn("hits", hits).groupBy("number", "event_time").agg(*[F.sum(c).alias(c) for c in ("evaluated", "matched", "hits")])
    return logged.select(_of_rule([rule["name"] for rule in rules]).alias("rule"), "event_time", "evaluated", "matched", "hits")
