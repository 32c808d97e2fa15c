"""The closed loop: requests to stored actions, polls of the rules."""

import datetime as dt

from conftest import NOON, event, rows
from test_edges import _requests

from opsight.operators import actions, loop, routing, rules
from opsight.schemas import ACTION, RAW, RULE_HITS
from opsight.sources import manifest, tables

RESTOCK = {"action": "TriggerRestock", "ingredientId": "beef", "stockPct": "7.5", "orderId": None, "stationId": None}
THROTTLE = {"action": "ThrottleChannel", "channel": "takeout", "durationMinutes": "30", "severity": None}
COMPENSATE = {"action": "IssueCompensation", "compensationType": "voucher", "orderId": "o9"}


def late_delivery(at, order, **more):
    return event("order.prep.delayed", at, order=order, channel="delivery", payload={"delay_minutes": 9, "queue_size": 9}, **more)


def test_all_contracts_reach_the_actions_once(spark, raw, folder):
    routing.fan_out(raw(event("order.created", 0, order="o1")), folder, "day")
    requests = _requests(spark, {}, RESTOCK, THROTTLE, COMPENSATE, {**THROTTLE, "durationMinutes": "61"}, {"action": "Dance"})
    for load in ("first", "first", "second"):
        checked = loop.submit_requests(spark, folder, requests, load)
    assert checked.where("valid").count() == 4
    done = tables.read_table(spark, folder, ACTION)
    assert rows(done, "action_type", "severity") == [
        ("action.channel.throttled", "warning"),
        ("action.compensation.issued", "warning"),
        ("action.kitchen.reprioritized", "warning"),
        ("action.restock.triggered", "warning"),
    ]
    landed = {r.event_name: r for r in tables.read_table(spark, folder, RAW).where("entity_type = 'action'").collect()}
    assert len(landed) == 4 and landed["action.restock.triggered"].ingredient_id == "beef"
    assert landed["action.channel.throttled"].channel == "takeout" and landed["action.compensation.issued"].channel == ""
    assert landed["action.compensation.issued"].order_id == "o9" and landed["action.restock.triggered"].order_id == ""
    alone = actions.action_events(requests.where("request_id = '0'")).first()
    assert landed["action.kitchen.reprioritized"].event_id == alone.event_id
    assert landed["action.kitchen.reprioritized"].payload == alone.payload


def test_append_looks_at_the_days_of_the_events_only(spark, raw, folder):
    routing.fan_out(raw(event("order.created", 0, order="o1"), event("order.created", dt.datetime(2024, 3, 1), order="o2")), folder, "days")
    loop.append_events(spark, folder, raw(event("action.x", 5, id="new"), event("action.x", 5, id="new")), "more")
    loop.append_events(spark, folder, raw(event("action.x", 5, id="new")).limit(0), "nothing")
    assert rows(tables.read_table(spark, folder, ACTION), "event_id") == [("new",)]
    assert tables.read_table(spark, folder, RAW).count() == 3


def test_overlapping_polls_report_each_hit_once(spark, raw, folder):
    def poll(minutes, **options):
        found = loop.poll_rules(spark, folder, NOON + dt.timedelta(minutes=minutes), late="10m", **options)
        return rows(found, "rule", "key", "occurrences")

    routing.fan_out(raw(late_delivery(60, "a"), late_delivery(120, "b")), folder, 0)
    assert poll(5) == [("DelayedOrderHighQueue", "a", 1), ("DelayedOrderHighQueue", "b", 1)]
    assert poll(5) == [("DelayedOrderHighQueue", "a", 1), ("DelayedOrderHighQueue", "b", 1)]  # the same poll again
    # one event late inside the allowance, which also fills the bucket; one far too late; one that is new
    routing.fan_out(raw(late_delivery(180, "late"), late_delivery(-90_000, "lost"), late_delivery(420, "new")), folder, 1)
    assert poll(8) == [("DelayedOrderHighQueue", "late", 1), ("DelayedOrderHighQueue", "new", 1), ("DeliveryChannelSaturation", "delivery", 3)]
    assert poll(9) == []
    everything = rows(loop.reported_hits(spark, folder), "rule", "key")
    assert len(everything) == 5 == tables.read_table(spark, folder, RULE_HITS).count()
    manifest.checkpoint(spark, folder)  # the mark survives
    assert poll(9) == [] and poll(3) == []


def test_a_poll_that_dies_has_no_effect(spark, raw, folder, monkeypatch):
    routing.fan_out(raw(late_delivery(60, "a")), folder, 0)
    with monkeypatch.context() as broken:
        broken.setattr(manifest, "publish_load", lambda *_: 1 / 0)
        try:
            loop.poll_rules(spark, folder, NOON + dt.timedelta(minutes=5))
        except ZeroDivisionError:
            pass
    assert manifest.state(spark, folder).mark("rules") is None
    hits = loop.poll_rules(spark, folder, NOON + dt.timedelta(minutes=6))
    assert rows(hits, "key") == [("a",)]
    for load in ("acts", "acts", "acts-again"):
        loop.act_on_hits(spark, folder, hits, load)
    assert rows(tables.read_table(spark, folder, ACTION), "action_type") == [("action.kitchen.reprioritized",)]


def test_event_names_count_on_every_table(raw):
    def rule(table, key, name):
        return {"name": name, "source": {"table": table, "eventName": name}, "keyField": key, "condition": {"all": []}, "action": {"eventName": "action.a"}}

    from opsight.plans.tables import OpsTables

    t = OpsTables.from_raw(raw(
        event("agent.recommendation", 0, payload={"recommendation_id": "R1"}),
        event("agent.other", 1, payload={"recommendation_id": "R2"}),
        event("approval.decision", 2, payload={"recommendation_id": "R1", "approver": "x"}),
        event("kitchen.station.updated", 3, station="grill"),
        event("action.a", 4, payload={"action_id": "A"}),
    ))
    book = [
        rule("agent_events", "recommendation_id", "agent.other"),
        rule("approval_events", "approver", "approval.never"),
        rule("kitchen_events", "station_id", "kitchen.other"),
        rule("action_events", "action_id", "action.a"),
    ]
    assert rows(rules.rule_hits(t, book), "rule", "key") == [("action.a", "A"), ("agent.other", "R2")]
    assert rows(rules.rule_log(t, book), "rule", "evaluated", "hits") == [("action.a", 1, 1), ("agent.other", 1, 1)]
    nested = [{**rule("agent_events", "recommendation_id", "agent.other"), "condition": {"all": [{"field": "payload.recommendation_id", "operator": "==", "value": "R1"}]}}]
    assert rows(rules.rule_hits(t, nested)) == []


def test_rules_on_a_stream_equal_batch_and_follow_their_file(spark, raw, folder):
    """A book with event rules and windows, micro-batch by micro-batch; a bucket fills over two of them."""
    import json

    from opsight.plans.rulebook import DEFAULT_RULES, load_rules
    from opsight.plans.tables import OpsTables
    from opsight.sources import events
    from opsight.streaming.rules import stream_rules

    path, root, checkpoint = f"{folder}/rules.json", f"{folder}/tables", f"{folder}/checkpoint"
    parts = [
        [late_delivery(10, "a"), late_delivery(20, "b"), event("agent.recommendation", 25, payload={"recommendation_id": "R1", "priority": 1})],
        [late_delivery(30, "c"), late_delivery(40, "d"), event("agent.recommendation", 50, payload={"recommendation_id": "R2", "priority": 1})],
        [late_delivery(15, "late")],
    ]
    urgent = {"name": "Urgent", "source": {"table": "agent_events", "eventName": "agent.recommendation"}, "keyField": "recommendation_id",
              "condition": {"all": [{"field": "priority", "operator": "==", "value": 1}]}, "action": {"eventName": "action.x"}}

    def run(part, book):
        with open(path, "w", encoding="utf-8") as out:
            json.dump(book, out)
        events.write_json(raw(*part).coalesce(1), f"{folder}/in")
        stream_rules(events.stream_raw(spark, f"{folder}/in"), root, checkpoint, lambda: load_rules(path)).awaitTermination()
        return rows(loop.reported_hits(spark, root), "rule", "key", "occurrences")

    assert run(parts[0], DEFAULT_RULES) == [("DelayedOrderHighQueue", k, 1) for k in "ab"]
    second = run(parts[1], [*DEFAULT_RULES, urgent])
    assert ("DeliveryChannelSaturation", "delivery", 4) in second and ("Urgent", "R2", 1) in second
    found = run(parts[2], [*DEFAULT_RULES, urgent])
    batch = rules.rule_hits(OpsTables.from_raw(raw(*parts[0], *parts[1], *parts[2])), DEFAULT_RULES)
    assert [r for r in found if r[0] != "Urgent"] == rows(batch, "rule", "key", "occurrences")
    assert ("DeliveryChannelSaturation", "delivery", 5) in found
