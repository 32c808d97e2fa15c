"""Relations between queries that hold on any data."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from opsight.functions import latest_by
from opsight.operators import dashboard, operational, questions, routing, rules
from opsight.plans.catalog import AS_OF, LOAD, ops_tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return ops_tables(spark, FOLDER)


def test_routing_partitions_raw(t):
    counts = dict(rows(routing.route_counts(t.raw)))
    assert sum(counts.values()) == t.raw.count()
    ids = None
    for route in routing.ROUTES.values():
        part = route(t.raw).select("event_id")
        ids = part if ids is None else ids.unionByName(part)
    assert ids.count() == ids.distinct().count() == t.raw.count() - counts.get("unrouted", 0)


def test_one_row_per_key(t):
    newest = latest_by(t.orders, "order_id")
    orders = t.orders.select("order_id").distinct().count()
    assert newest.count() == newest.select("order_id").distinct().count() == orders
    top = t.orders.groupBy("order_id").agg(F.max("event_time").alias("event_time"))
    assert newest.join(top, ["order_id", "event_time"]).count() == newest.count()


def test_day_totals_add_up(t):
    created = dashboard.orders_today(t.orders, AS_OF).first().Total
    active = dashboard.active_orders(t.orders, AS_OF).first().Total
    completed = dashboard.completed_today(t.orders, AS_OF).first().Total
    assert active + completed == created
    assert dashboard.completed_with_delay(t.orders, AS_OF).first().Total <= completed


def test_alerts_are_the_operational_queries(t):
    assert rows(rules.delayed_order_alerts(t.orders)) == rows(operational.delayed_high_queue(t.orders))
    assert rows(rules.inventory_alerts(t.inventory)) == rows(operational.critical_inventory(t.inventory))


def test_station_counts_sum_to_the_total(t):
    per_station = questions.active_by_station(t.orders, t.stations, AS_OF, LOAD)
    total = questions.active_count(t.orders, AS_OF, LOAD).first().Count
    assert (per_station.agg(F.sum("queue_size")).first()[0] or 0) == total


def test_event_level_rules_give_one_hit_per_alert(t):
    hits = dict(rows(rules.rule_hits(t).groupBy("rule").count()))
    assert hits.get("DelayedOrderHighQueue", 0) == rules.delayed_order_alerts(t.orders).count()
    assert hits.get("CriticalInventory", 0) == rules.inventory_alerts(t.inventory).count()
    log = dict(rows(rules.rule_log(t).groupBy("rule").agg(F.sum("hits"))))
    assert {k: v for k, v in log.items() if v} == {k: v for k, v in hits.items() if v}
