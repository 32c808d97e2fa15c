"""Edge rows: odd payloads, blanks, ties, bucket edges, bad requests."""

import datetime as dt
import math

from conftest import NOON, event, rows

from opsight.functions import as_int, as_long, latest_by
from opsight.operators import actions, dashboard, operational, questions, routing, rules, signals
from opsight.plans.rulebook import load_rules
from opsight.plans.tables import OpsTables

AS_OF = NOON + dt.timedelta(minutes=9)


def late(at, delay=8, queue=9, order="o1", station="grill", channel="delivery", **more):
    payload = {"order_status": "in_prep", "delay_minutes": delay, "queue_size": queue, **more}
    return event("order.prep.delayed", at, order=order, station=station, channel=channel, payload=payload)


def test_numbers_in_any_shape(spark):
    values = spark.createDataFrame([("9",), ("9.0",), ("x",), (None,), ("9.7",), ("3000000000",)], "v string")
    assert [tuple(r) for r in values.select(as_long("v"), as_int("v")).collect()] == [
        (9, 9),
        (9, 9),
        (None, None),
        (None, None),
        (9, 9),
        (3000000000, None),
    ]


def test_queue_size_shapes(raw):
    t = OpsTables.from_raw(
        raw(
            late(0, queue=9, order="int"),
            late(1, queue=9.0, order="float"),
            late(2, queue="x", order="text"),
            event("order.prep.delayed", 3, order="absent", payload={"delay_minutes": 9}),
            event("order.prep.delayed", 4, order="broken", payload='{"delay_minutes": 9, "queue'),
            event("order.prep.delayed", 5, order="none", payload=None),
        )
    )
    assert rows(operational.delayed_high_queue(t.orders), "order_id", "queue_size") == [("float", 9), ("int", 9)]
    assert t.orders.count() == 6


def test_prefix_ignores_case_and_equality_does_not(raw):
    counts = routing.route_counts(
        raw(event("AGENT.Recommendation", 0, payload={"recommendation_id": "R"}), event("ORDER.CREATED", 1))
    )
    assert {k: n for k, n in rows(counts) if n} == {"agent_events": 1, "unrouted": 1}
    assert len(rows(counts)) == 7


def test_missing_strings_become_blank(raw):
    bare = (NOON, None, "order.created", *[None] * 8)
    row = routing.route_orders(raw(bare)).first()
    assert (row.event_id, row.order_id, row.channel, row.order_status, row.station_id, row.severity) == ("",) * 6


def test_ties_go_to_the_larger_event_id(raw):
    df = raw(event("a", 0, order="o", id="e1"), event("b", 0, order="o", id="e2"), event("c", -1, order="o", id="e3"))
    assert rows(latest_by(df, "order_id"), "event_id") == [("e2",)]


def test_station_without_capacity(spark, raw):
    t = OpsTables.from_raw(raw(late(0, station="new")))
    stations = spark.createDataFrame(
        [("new", "New", "x", 0, 2.0, True)], t.stations.schema
    )
    row = dashboard.station_status(t.orders, stations, AS_OF).first()
    assert (row.active_orders, row.queue_size, row.load_pct, row.station_status) == (1, 1, 0.0, "active")
    assert math.isinf(row.drain_minutes)


def test_burst_over_a_bucket_edge(raw):
    t = OpsTables.from_raw(raw(late(290), late(295), late(305)))
    assert rows(rules.channel_saturation(t.orders)) == []
    found = rules.channel_saturation_sliding(t.orders)
    assert rows(found, "event_time", "delayed_count", "max_delay") == [(NOON + dt.timedelta(seconds=305), 3, 8.0)]


def test_sliding_against_brute_force(raw):
    times = [0, 10, 10, 250, 299, 300, 301, 480, 600, 601, 900, 901, 902, 1300]
    delays = [5 + (7 * i) % 11 for i in range(len(times))]
    t = OpsTables.from_raw(raw(*[late(x, delay=d) for x, d in zip(times, delays)]))
    expected = []
    for s in sorted(set(times)):
        inside = [d for x, d in zip(times, delays) if s - 300 < x <= s]
        expected.append((NOON + dt.timedelta(seconds=s), len(inside), float(max(inside))))
    found = rules.channel_saturation_sliding(t.orders, min_count=1)
    assert sorted(tuple(r) for r in found.select("event_time", "delayed_count", "max_delay").collect()) == expected


def test_any_channel(raw):
    t = OpsTables.from_raw(raw(*[late(i, channel="takeout") for i in range(3)]))
    assert rows(rules.channel_saturation(t.orders)) == []
    assert rows(rules.channel_saturation(t.orders, channel=None), "channel") == [("takeout",)]


def test_review_repeats_an_order_per_signal(raw):
    def signal(at, reason):
        return event(
            "customer.sentiment.signal", at, order="o1", payload={"sentiment": "negative", "reason": reason}
        )

    t = OpsTables.from_raw(
        raw(late(0), late(1), late(2, delay=6, order="o2"), signal(3, "cold"), signal(4, "cold"), signal(5, "slow"))
    )
    found = rows(operational.agent_review(t.orders), "order_id", "sentiment", "reason")
    assert found == sorted([("o1", "negative", r) for r in ("cold", "cold", "slow")] * 2, key=repr)


def test_review_of_an_order_with_very_many_signals(spark, raw):
    hot = spark.range(3000).selectExpr(
        "timestamp'2024-01-01 12:00:00' AS event_time", "concat('s', id) AS event_id",
        "'customer.sentiment.signal' AS event_name", "'' AS entity_type", "'' AS entity_id", "'hot' AS order_id",
        "'' AS station_id", "'' AS ingredient_id", "'' AS channel", "'info' AS severity",
        """concat('{"sentiment":"negative","reason":"', IF(id % 3 = 0, 'a', 'b'), '"}') AS payload""",
    )
    t = OpsTables.from_raw(raw(late(0, order="hot"), late(1, order="hot"), late(2, order="calm")).unionByName(hot))
    found = operational.agent_review(t.orders).groupBy("order_id", "reason").count()
    assert rows(found) == [("calm", None, 1), ("hot", "a", 2000), ("hot", "b", 4000)]
    counted = operational.agent_review_counts(t.orders)
    assert rows(counted, "order_id", "reason", "negative_signals") == sorted(
        [("calm", None, 0), ("hot", "a", 1000), ("hot", "a", 1000), ("hot", "b", 2000), ("hot", "b", 2000)], key=repr
    )


def test_blank_and_missing_approvals(raw):
    def reco(at, rec):
        return event("agent.recommendation", at, order="o", payload={"recommendation_id": rec})

    def decision(at, rec, **status):
        return event("approval.decision", at, payload={"recommendation_id": rec, **status})

    t = OpsTables.from_raw(
        raw(
            reco(0, "none"),
            reco(1, "blank"),
            decision(2, "blank", approval_status=""),
            reco(3, "statusless"),
            decision(4, "statusless"),
            reco(5, "yes"),
            decision(6, "yes", approval_status="approved"),
            reco(7, "no-then-pending"),
            decision(8, "no-then-pending", approval_status="rejected"),
            decision(9, "no-then-pending", approval_status="pending"),
        )
    )
    pending = questions.pending_recommendations(t.agent, t.approval, t.orders, t.stations, AS_OF)
    assert [r[0] for r in rows(pending, "recommendation_id")] == ["blank", "no-then-pending", "none", "statusless"]


def test_actions_need_an_approval_before_them(raw):
    def decided(at, rec, status):
        return event("approval.decision", at, payload={"recommendation_id": rec, "approval_status": status})

    def acted(at, name, rec=None):
        return event("action.x", at, payload={"action_id": name, **({"recommendation_id": rec} if rec else {})})

    t = OpsTables.from_raw(
        raw(
            decided(0, "R1", "approved"),
            acted(1, "fine", "R1"),
            acted(2, "early", "R2"),
            decided(3, "R2", "approved"),
            decided(4, "R3", "rejected"),
            acted(5, "refused", "R3"),
            acted(6, "unlinked"),
        )
    )
    assert [r[0] for r in rows(actions.ungated_actions(t.action, t.approval), "action_id")] == [
        "early",
        "refused",
        "unlinked",
    ]


_REQUEST = {
    "request_id": "q",
    "request_time": NOON,
    "action": "ReprioritizeOrder",
    "orderId": " o1 ",
    "stationId": "grill",
    "priority": "urgent",
    "reason": "late",
    "approvedBy": "ana",
    "channel": "delivery",
    "severity": "warning",
    "ingredientId": None,
    "stockPct": None,
    "durationMinutes": None,
    "compensationType": None,
}


def _requests(spark, *changes):
    kinds = ", ".join(f"{c} {'timestamp' if c == 'request_time' else 'string'}" for c in _REQUEST)
    return spark.createDataFrame([tuple({**_REQUEST, "request_id": str(i), **c}.values()) for i, c in
                                  enumerate(changes)], kinds)


def test_request_contracts(spark):
    throttle = {"action": "ThrottleChannel", "channel": "takeout"}
    restock = {"action": "TriggerRestock", "ingredientId": "beef"}
    checked = actions.validate_requests(
        _requests(
            spark,
            {},
            {"stationId": "oven"},
            {"orderId": "  ", "priority": None},
            {**throttle, "durationMinutes": "61"},
            {**throttle, "durationMinutes": "60"},
            {**throttle, "durationMinutes": "soon"},
            {**restock, "stockPct": "100.5"},
            {**restock, "stockPct": "7.5", "severity": "info"},
            {"action": "Dance"},
        )
    )
    assert dict(rows(checked, "request_id", "errors")) == {
        "0": "",
        "1": "stationId:enum",
        "2": "orderId:required;priority:required",
        "3": "durationMinutes:range",
        "4": "",
        "5": "durationMinutes:type",
        "6": "stockPct:range",
        "7": "severity:enum",
        "8": "action:unknown",
    }
    assert checked.where("valid").count() == 2


def test_action_events_from_requests(spark):
    requests = _requests(spark, {}, {"stationId": " "}, {"channel": None, "severity": None})
    first = actions.action_events(requests, NOON).orderBy("event_id").collect()
    again = actions.action_events(requests, NOON).orderBy("event_id").collect()
    assert first == again and len(first) == 2
    assert {(r.order_id, r.channel, r.severity) for r in first} == {("o1", "delivery", "warning")}
    routed = routing.route_action(actions.action_events(requests, NOON)).first()
    assert routed.action_type == "action.kitchen.reprioritized" and routed.action_status == "approved"


def test_rules_from_a_file(raw, folder):
    path = f"{folder}/rules.json"
    with open(path, "w", encoding="utf-8") as out:
        out.write(
            '{"rules": [{"name": "Vip", "source": {"table": "order_events", "eventName": "order.prep.delayed"},'
            '"keyField": "order_id", "condition": {"all": [{"field": "payload.type", "operator": "==",'
            '"value": "premium"}, {"field": "delay_minutes", "operator": ">", "value": 3}]},'
            '"action": {"eventName": "action.call"}}]}'
        )
    t = OpsTables.from_raw(raw(late(0, type="premium"), late(1, order="o2", type="standard")))
    assert rows(rules.rule_hits(t, load_rules(path)), "rule", "key", "action") == [("Vip", "o1", "action.call")]


def test_signal_count(raw):
    t = OpsTables.from_raw(
        raw(
            *[late(i, order=f"o{i}") for i in range(5)],
            late(6, delay=2, order="mild", station="fryer", channel="takeout"),
            event("customer.sentiment.signal", 7, order="o1", payload={"sentiment": "negative"}),
            event("inventory.level.changed", 8, ingredient="beef", payload={"stock_pct": 1, "threshold_pct": 5}),
        )
    )
    found = signals.signal_correlation(t.orders, t.kitchen, t.inventory, t.stations, AS_OF)
    assert dict(rows(found, "order_id", "signal_count")) == {"o0": 4, "o1": 5, "o2": 4, "o3": 4, "o4": 4, "mild": 1}
    over = signals.delay_over_capacity(t.orders, t.stations, AS_OF)
    assert rows(over, "order_id", "active_orders") == [(f"o{i}", 5) for i in range(5)]
