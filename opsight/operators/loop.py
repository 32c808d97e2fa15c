"""The closed loop on stored tables: requests and rule hits become action events, each exactly once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.functions import as_double, as_int, instant, span, utc_day
from opsight.functions.timebox import moment
from opsight.operators.actions import APPROVED, CONTRACTS, DEFAULT_CHANNEL, DEFAULT_SEVERITY, REPRIORITIZED, given, validate_requests
from opsight.operators.routing import fan_out
from opsight.operators.rules import action_events_from_hits, hit_id, rule_hits
from opsight.plans.rulebook import DEFAULT_RULES
from opsight.plans.tables import OpsTables
from opsight.schemas import RAW, RAW_COLUMNS, RULE_HITS
from opsight.sources import manifest
from opsight.sources.tables import read_table, write_files

# --- fixed values: the event of each contract ------------------------------------------------------------------------
EVENT_OF = {
    "ReprioritizeOrder": REPRIORITIZED,
    "TriggerRestock": "action.restock.triggered",
    "ThrottleChannel": "action.channel.throttled",
    "IssueCompensation": "action.compensation.issued",
}
# ---------------------------------------------------------------------------------------------------------------------

When = str | dt.datetime
_EPOCH = dt.datetime(1970, 1, 1)


def request_events(requests: DataFrame, as_of: When | None = None) -> DataFrame:
    """Action events of the requests that meet their contract, in the raw layout, for all four contracts.

    Identifiers follow from the request, so sending it again gives the same event; those of reprioritizations are the
    same as in `action_events`. Parameters a contract does not have stay blank.
    """
    requests = validate_requests(requests).where("valid")

    def parameter(name: str) -> Column:
        """The value where the contract of the row's action has this parameter, else blank."""
        having = [action for action, parameters in CONTRACTS.items() if name in parameters]
        return F.when(F.col("action").isin(*having), given(requests, name)).otherwise("")

    def optional(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    order_id, station_id, ingredient_id = parameter("orderId"), parameter("stationId"), parameter("ingredientId")
    own = F.concat_ws("|", "request_id", order_id, station_id)
    other = F.concat_ws("|", "request_id", "action", order_id, ingredient_id, parameter("channel"))
    digest = F.substring(F.sha2(F.when(F.col("action") == "ReprioritizeOrder", own).otherwise(other), 256), 1, 32)
    action_id = F.concat(F.lit("act-"), digest)
    payload = F.to_json(
        F.struct(
            action_id.alias("action_id"),
            F.lit(APPROVED).alias("action_status"),
            optional(parameter("priority")).alias("priority"),
            given(requests, "reason").alias("reason"),
            optional(parameter("approvedBy")).alias("approved_by"),
            optional(given(requests, "recommendationId")).alias("recommendation_id"),
            as_double(optional(parameter("stockPct"))).alias("stock_pct"),
            as_int(optional(parameter("durationMinutes"))).alias("duration_minutes"),
            optional(parameter("compensationType")).alias("compensation_type"),
        )
    )
    name = F.create_map(*[F.lit(v) for pair in EVENT_OF.items() for v in pair])[F.col("action")]
    channel = F.when(F.col("action").isin("ReprioritizeOrder", "ThrottleChannel"), F.coalesce(optional(parameter("channel")), F.lit(DEFAULT_CHANNEL)))
    return requests.select(
        (F.col("request_time") if as_of is None else instant(requests, as_of, "request_time")).alias("event_time"),
        F.concat(F.lit("evt-"), digest).alias("event_id"),
        name.alias("event_name"),
        F.lit("action").alias("entity_type"),
        action_id.alias("entity_id"),
        order_id.alias("order_id"),
        station_id.alias("station_id"),
        ingredient_id.alias("ingredient_id"),
        F.coalesce(channel, F.lit("")).alias("channel"),
        F.coalesce(optional(parameter("severity")), F.lit(DEFAULT_SEVERITY)).alias("severity"),
        payload.alias("payload"),
    ).select(*RAW_COLUMNS)


def append_events(spark: SparkSession, root: str, events: DataFrame, load: str) -> None:
    """Append derived events with identifiers of their own to raw and the six tables; what is there is not added again.

    The comparison reads raw events of the days that the new ones fall on, and of these columns only the id. Running
    the same load again changes nothing, and neither does another load with the same events.
    """
    state = manifest.state(spark, root)
    if state.load_parts(RAW, load)[1] is not None:
        return
    day = utc_day(events)
    first, last = events.agg(F.min(day), F.max(day)).first()
    known = read_table(spark, root, RAW, state=state)
    known = known.where(F.col("event_date").between(F.lit(first), F.lit(last))) if first else known.limit(0)
    fan_out(events.dropDuplicates(["event_id"]).join(known.select("event_id"), "event_id", "left_anti").select(*RAW_COLUMNS), root, load)


def submit_requests(spark: SparkSession, root: str, requests: DataFrame, load: str) -> DataFrame:
    """Append the events of valid requests; returns all requests with `valid` and `errors`."""
    append_events(spark, root, request_events(requests), load)
    return validate_requests(requests)


def poll_rules(
    spark: SparkSession, root: str, as_of: When, rules: list[dict] = DEFAULT_RULES, *, late: str = "10m", first: str = "1d", name: str = "rules"
) -> DataFrame:
    """Evaluate rules on what came since the last poll, and report every hit once.

    A mark says up to where rules have been evaluated; it is published with the hits in one record, so a poll that dies
    has no effect and one that runs again finds nothing new. Each poll looks back `late` behind the mark, and to the
    start of the windows that this cuts, so events that arrive late inside the allowance still hit; hits that are there
    already are left out by their identifier. `first` is how far the very first poll looks back. A windowed hit is
    reported when its bucket reaches the minimum, with the occurrences up to then. Returns the new hits.
    """
    state, end = manifest.state(spark, root), moment(as_of)
    mark = state.mark(name)
    load = f"{name}-{end:%Y%m%dT%H%M%S.%f}"
    if mark is None or end > moment(mark):
        since = end - span(first) if mark is None else moment(mark) - span(late)
        evaluate_range(spark, root, rules, since, end, load, marks={name: end.isoformat()})
    return read_table(spark, root, RULE_HITS, load).drop("event_date")


def evaluate_range(
    spark: SparkSession,
    root: str,
    rules: list[dict],
    since: dt.datetime,
    end: dt.datetime,
    load: str,
    *,
    marks: dict[str, str] | None = None,
    growing: bool = False,
) -> None:
    """Store the hits of stored events from `since` to `end` that are not there yet, as one load.

    The range begins earlier where `since` would cut a rule's window. With `growing` it also ends later where `end`
    would cut one, and a windowed hit is stored again when its bucket has filled up further; `reported_hits` shows the
    last count. A load that is there stays as it is.
    """
    state = manifest.state(spark, root)
    if state.load_parts(RULE_HITS, load)[1] is not None:
        return
    windows = [span(r["condition"]["window"]) for r in rules if "window" in r["condition"]]
    since = min([since, *[since - (since - _EPOCH) % w for w in windows]])
    if growing:
        end = max([end, *[end - (end - _EPOCH) % w + w - dt.timedelta(microseconds=1) for w in windows]])
    found = rule_hits(OpsTables.stored(spark, root), rules, end, end - since)
    found = found.withColumn("hit_id", hit_id("hit-")).dropDuplicates(["hit_id"])
    known = read_table(spark, root, RULE_HITS, state=state)
    known = known.where(F.col("event_date").between(F.lit(since.date()), F.lit(end.date())))
    known = known.groupBy("hit_id").agg(F.max("occurrences").alias("reported"))
    test = found["hit_id"] == known["hit_id"]
    if growing:
        test = test & (known["reported"] >= found["occurrences"])
    stamp = manifest.new_stamp()
    cells = write_files(found.join(known, test, "left_anti"), root, RULE_HITS, load, stamp)
    manifest.publish_load(spark, root, load, stamp, {RULE_HITS: cells}, marks)


def reported_hits(spark: SparkSession, root: str) -> DataFrame:
    """All reported hits, each once with its last count, also where it was stored more than once."""
    hits = read_table(spark, root, RULE_HITS).drop("event_date")
    newest = F.max_by(F.struct(*[c for c in hits.columns if c != "hit_id"]), "occurrences").alias("hit")
    return hits.groupBy("hit_id").agg(newest).select("hit_id", "hit.*")


def act_on_hits(spark: SparkSession, root: str, hits: DataFrame, load: str) -> None:
    """Append the action events of hits."""
    append_events(spark, root, action_events_from_hits(hits), load)
