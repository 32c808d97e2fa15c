"""Worked-out cases with known answers."""

import datetime as dt

import pytest
from conftest import NOON, event, rows
from shift import evening_shift

from opsight.operators import dashboard, operational, quality, questions, routing, rules
from opsight.plans.tables import OpsTables

AS_OF = NOON + dt.timedelta(minutes=1)


@pytest.fixture
def shift(spark, raw):
    return OpsTables.from_raw(raw(*evening_shift()))


def test_shift_routing(shift):
    assert dict(rows(shift.raw.groupBy("event_name").count())) == {
        "order.created": 6,
        "kitchen.station.updated": 3,
        "inventory.level.changed": 3,
        "payment.completed": 5,
        "order.prep.delayed": 5,
        "customer.sentiment.signal": 2,
    }
    assert dict(rows(routing.route_counts(shift.raw))) == {
        "order_events": 18,
        "kitchen_events": 3,
        "inventory_events": 3,
        "agent_events": 0,
        "approval_events": 0,
        "action_events": 0,
        "unrouted": 0,
    }


def test_shift_operational(shift):
    late = operational.delayed_high_queue(shift.orders)
    assert sorted(rows(late, "station_id", "delay_minutes", "queue_size")) == [
        ("assembly", 12.0, 7),
        ("fryer", 6.0, 9),
        ("fryer", 7.5, 8),
    ]
    assert rows(operational.critical_inventory(shift.inventory), "ingredient_id", "stock_pct") == [("fries", 5.0)]
    load = {r.station_id: (r.max_queue, r.avg_queue, r.events) for r in
            operational.station_saturation(shift.kitchen).collect()}
    assert load == {"fryer": (9, 7.0, 2)}  # the grill never had a high queue
    assert rows(operational.agent_review(shift.orders), "order_id", "sentiment") == [
        ("A3", "negative"), ("A5", "negative"),
    ]


def test_shift_dashboard(shift):
    def total(df):
        return df.first()[0]

    assert total(dashboard.orders_today(shift.orders, AS_OF)) == 6
    assert total(dashboard.orders_today(shift.orders, AS_OF, approximate=True)) == 6
    assert total(dashboard.active_orders(shift.orders, AS_OF)) == 1
    assert total(dashboard.completed_today(shift.orders, AS_OF)) == 5
    assert total(dashboard.completed_with_delay(shift.orders, AS_OF)) == 4
    status = dashboard.station_status(shift.orders, shift.stations, AS_OF)
    assert rows(status, "station_id", "station_status", "active_orders") == [
        ("assembly", "idle", 0), ("fryer", "idle", 0), ("grill", "active", 1), ("sauces", "idle", 0),
    ]
    pressure = dashboard.station_pressure(shift.orders, AS_OF)
    assert rows(pressure, "station_id", "Created", "Delayed", "Completed") == [
        ("assembly", 1, 1, 1), ("fryer", 2, 2, 2), ("grill", 2, 1, 1), ("sauces", 1, 1, 1),
    ]
    assert rows(dashboard.critical_inventory_last(shift.inventory), "ingredient_id") == [("fries",)]


def test_shift_questions(shift):
    assert questions.active_count(shift.orders, AS_OF).first().Count == 1
    assert rows(questions.active_by_station(shift.orders, shift.stations, AS_OF), "station_id", "queue_size") == [("grill", 1)]
    assert rows(questions.completed_by_station(shift.orders, shift.stations, AS_OF), "station_id", "completed") == [
        ("assembly", 1), ("fryer", 2), ("grill", 1), ("sauces", 1),
    ]
    assert rows(questions.critical_now(shift.inventory, AS_OF)) == []


def test_open_order_has_no_status(raw):
    """A sentiment signal has no status: an order whose newest event it is counts as open."""
    t = OpsTables.from_raw(raw(*[e for e in evening_shift() if e[2] != "payment.completed"]))
    assert questions.active_count(t.orders, AS_OF).first().Count == 6


def test_shift_rules_and_lifecycle(shift):
    assert rows(rules.channel_saturation(shift.orders), "channel", "delayed_count", "max_delay") == [
        ("delivery", 3, 12.0)
    ]
    assert rows(quality.lifecycle_violations(shift.orders)) == []
    assert rows(quality.open_orders(shift.orders, AS_OF), "order_id") == [("A6",)]


def _rule(table, key, tests, event_name=None, **condition):
    return {
        "name": "r", "source": {"table": table, "eventName": event_name}, "keyField": key,
        "condition": {"all": tests, **condition}, "action": {"eventName": "action.x"},
    }


def test_rules_beyond_the_default_ones(raw):
    premium = {"field": "payload.is_premium", "operator": "==", "value": True}
    other = {"field": "payload.zone", "operator": "!=", "value": "north"}
    t = OpsTables.from_raw(
        raw(
            event("order.created", 0, order="1", station="s1", payload={"is_premium": True, "zone": "north"}),
            event("order.created", 0, order="2", station="s1", payload={"is_premium": False}),
            event("order.created", 0, order="3", station="s1", payload={}),
            event("action.a", 5, payload={"action_id": "x", "action_type": "action.a"}),
            event("action.b", 5, payload={"action_id": "y", "action_type": "action.b"}),
        )
    )
    assert rows(rules.rule_hits(t, [_rule("order_events", "order_id", [premium])]), "key") == [("1",)]
    assert rows(rules.rule_hits(t, [_rule("order_events", "order_id", [other])]), "key") == [("2",), ("3",)]
    assert rows(rules.rule_hits(t, [_rule("action_events", "action_id", [], "action.a")]), "key") == [("x",)]
    made = rules.action_events_from_hits(rules.rule_hits(t, [_rule("order_events", "station_id", [])])).collect()
    assert len({r.event_id for r in made}) == 3 and {r.station_id for r in made} == {"s1"}
    with pytest.raises(ValueError):
        rules.rule_hits(t, [_rule("order_events", "order_id", [], minimumOccurrences=2)])


def test_stock_recovers(raw):
    def reading(at, pct):
        return event("inventory.level.changed", at, ingredient="beef", payload={"stock_pct": pct, "threshold_pct": 15})

    t = OpsTables.from_raw(raw(reading(0, 8), reading(300, 60)))
    later = NOON + dt.timedelta(minutes=10)
    assert len(rows(operational.critical_inventory(t.inventory))) == 1
    assert rows(dashboard.critical_inventory_last(t.inventory), "stock_pct") == [(8.0,)]
    assert rows(questions.critical_now(t.inventory, later)) == []


def _chain():
    midnight = dt.datetime(2024, 1, 1)

    def at(minute):
        return midnight + dt.timedelta(minutes=minute)

    order = {"order": "ORD-1042", "station": "grill", "channel": "delivery"}
    return [
        event("order.created", at(0), **order, payload={"order_status": "created", "items": 4}),
        event("kitchen.station.updated", at(5), station="grill", payload={"queue_size": 7, "capacity": 4}),
        event("inventory.level.changed", at(12), ingredient="bread", payload={"stock_pct": 15, "threshold_pct": 10}),
        event(
            "order.prep.delayed",
            at(18),
            **order,
            payload={"order_status": "in_prep", "delay_minutes": 6, "queue_size": 7},
        ),
        event(
            "agent.recommendation",
            at(19),
            **order,
            payload={"recommendation_id": "R1", "priority": 4, "confidence": 0.9},
        ),
        event(
            "approval.decision",
            at(20),
            **order,
            payload={"recommendation_id": "R1", "approver": "ana", "approval_status": "approved"},
        ),
        event(
            "action.kitchen.reprioritized",
            at(21),
            **order,
            payload={"action_id": "A1", "action_status": "completed", "recommendation_id": "R1"},
        ),
        event("kitchen.station.updated", at(25), station="grill", payload={"queue_size": 4, "capacity": 4}),
        event("payment.completed", at(30), **order, payload={"order_status": "completed"}),
    ]


def test_kitchen_example(raw):
    t = OpsTables.from_raw(raw(*_chain()))
    as_of = dt.datetime(2024, 1, 1, 1)
    trace = questions.full_trace(t.agent, t.approval, t.action, t.orders, t.stations, as_of).collect()
    assert len(trace) == 1 and all(v is not None for v in trace[0])
    assert trace[0].action_type == "action.kitchen.reprioritized" and trace[0].display_name == "Plancha / Parrilla"
    names = rows(operational.decision_trace(t.agent, t.approval, t.action), "event_name", "entity_id", "order_id")
    assert names == [
        ("action.kitchen.reprioritized", "A1", ""),
        ("agent.recommendation.created", "R1", "ORD-1042"),
        ("approval.approved", "R1", ""),
    ]
    assert dashboard.completed_with_delay(t.orders, as_of).first().Total == 1
    latency = quality.chain_latency(t.agent, t.approval, t.action, as_of)
    assert rows(latency, "decision_seconds", "action_seconds", "total_seconds") == [(60.0, 60.0, 120.0)]
    assert dict(rows(quality.shift_summary(t.raw, as_of))) == {
        "completed_on_time": 0,
        "completed_with_delay": 1,
        "delays_mitigated": 1,
        "actions_executed": 1,
    }
    assert rows(questions.pending_recommendations(t.agent, t.approval, t.orders, t.stations, as_of)) == []


def test_stock_example(raw):
    t = OpsTables.from_raw(
        raw(
            event("inventory.level.changed", 0, ingredient="tomato", payload={"stock_pct": 8, "threshold_pct": 15}),
            event("inventory.level.changed", 600, ingredient="tomato", payload={"stock_pct": 80, "threshold_pct": 15}),
        )
    )
    made = rules.action_events_from_hits(rules.rule_hits(t)).collect()
    assert [(r.event_name, r.ingredient_id, r.order_id) for r in made] == [("action.restock.triggered", "tomato", "")]
    stored = routing.route_action(rules.action_events_from_hits(rules.rule_hits(t))).first()
    assert stored.action_status == "triggered" and stored.action_id.startswith("act-")
