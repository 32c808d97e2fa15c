"""Streams against their batch counterparts, fed file by file."""

import datetime as dt
from pathlib import Path

import pytest

from conftest import NOON, event, rows
from shift import evening_shift

from opsight.functions import latest_by
from opsight.operators import dashboard, operational, rollups, routing, rules
from opsight.plans.tables import OpsTables
from opsight.schemas import QUARANTINE, ROLLUP
from opsight.sources import events, manifest, tables
from opsight.streaming import open_orders, routes, runner, windows

ONE_BY_ONE = {"maxFilesPerTrigger": "1"}


def _feed(raw, folder, *parts):
    for part in parts:
        events.write_json(raw(*part).coalesce(1), f"{folder}/in")
    return f"{folder}/in"


def _stream(spark, path):
    return events.stream_raw(spark, path, options=ONE_BY_ONE)


def _closing():
    """Events of every kind a day later, which let all windows close."""
    day = 86_400
    return [
        event("kitchen.station.updated", day, station="grill", payload={"queue_size": 1}),
        event("inventory.level.changed", day, ingredient="beef", payload={"stock_pct": 1, "threshold_pct": 2}),
        event("order.created", day, order="end", channel="takeout"),
        event("order.prep.delayed", day, order="end", payload={"delay_minutes": 9, "queue_size": 9}),
        event("customer.sentiment.signal", day, order="end", payload={"sentiment": "negative"}),
    ]


def test_routing_stream_equals_batch_and_resumes(spark, raw, folder):
    shift = evening_shift()
    path = _feed(raw, folder, shift[:20], shift[20:40])
    root, checkpoint = f"{folder}/tables", f"{folder}/checkpoint"
    routes.stream_route(_stream(spark, path), root, checkpoint).awaitTermination()
    _feed(raw, folder, shift[40:])
    routes.stream_route(_stream(spark, path), root, checkpoint).awaitTermination()
    for name, route in routing.ROUTES.items():
        if route(raw(*shift)).count():
            stored = tables.read_table(spark, root, name).drop("event_date")
            assert rows(stored) == rows(route(raw(*shift))), name


def test_landing_from_a_source_of_lines(spark, raw, folder):
    """Sources such as message queues deliver the JSON text as `value`."""
    shift = evening_shift()
    path = _feed(raw, folder, shift[:20], shift[20:])
    landed = runner.appended(spark, events.stream_raw(spark, path, source="text"), folder)
    assert rows(landed) == rows(raw(*shift))


def test_windows_equal_batch(spark, raw, folder):
    shift = evening_shift()
    path = _feed(raw, folder, shift[:12], shift[12:], _closing())
    noon = f"event_time < timestamp'{NOON + dt.timedelta(hours=1)}'"
    batch = OpsTables.from_raw(raw(*shift))

    def out(name, df):
        return runner.appended(spark, df, f"{folder}/{name}").where(noon)

    assert rows(out("t2", windows.stream_throughput(_stream(spark, path)))) == rows(dashboard.throughput(batch.raw))
    saturated = out("t3", windows.stream_saturation(_stream(spark, path)))
    assert rows(saturated.select(*sorted(saturated.columns))) == rows(
        operational.station_saturation(batch.kitchen).select(*sorted(saturated.columns))
    )
    crowded = out("t4", windows.stream_channel_saturation(_stream(spark, path)))
    assert rows(crowded) == rows(rules.channel_saturation(batch.orders))


def test_current_orders(spark, raw, folder):
    shift = evening_shift()
    path = _feed(raw, folder, shift[12:], shift[:12])
    routes.stream_order_states(
        routing.route_orders(_stream(spark, path)), folder, f"{folder}/checkpoint"
    ).awaitTermination()
    expected = latest_by(routing.route_orders(raw(*shift)), "order_id")
    assert rows(routes.current_orders(spark, folder), "order_id", "event_id") == rows(expected, "order_id", "event_id")


def test_delay_with_signal(spark, raw, folder):
    def delay(at, order):
        return event("order.prep.delayed", at, order=order, payload={"delay_minutes": 9, "queue_size": 9})

    def signal(at, order):
        return event("customer.sentiment.signal", at, order=order, payload={"sentiment": "negative", "reason": "r"})

    path = _feed(
        raw,
        folder,
        [delay(0, "before"), signal(60, "other")],
        [signal(600, "before"), delay(900, "after"), signal(800, "after"), delay(950, "far"), signal(9000, "far")],
        _closing(),
        [event("order.created", 200_000, order="late")],
    )
    df = windows.stream_delay_sentiment(_stream(spark, path))
    found = runner.appended(spark, df, folder).where("order_id <> 'end'")
    assert rows(found, "order_id", "reason") == [("after", "r"), ("before", "r"), ("far", None)]


def test_alerts_once(spark, raw, folder):
    shift = evening_shift()
    path = _feed(raw, folder, shift, shift[:12], shift[12:])
    found = runner.appended(spark, windows.stream_alerts_once(_stream(spark, path)), folder)
    t = OpsTables.from_raw(raw(*shift))
    expected = rows(operational.delayed_with_queue(t.orders), "event_id")
    expected += rows(operational.low_stock(t.inventory), "event_id")
    assert rows(found, "event_id") == sorted(expected)


def test_open_orders(spark, raw, folder):
    def step(name, at, order):
        return event(name, at, order=order)

    path = _feed(
        raw,
        folder,
        [step("order.created", 0, "paid"), step("order.created", 0, "open"), step("order.created", 60, "slow")],
        [step("order.prep.delayed", 600, "slow"), step("payment.completed", 900, "paid")],
        _closing(),
    )
    found = runner.appended(spark, windows.stream_open_orders(_stream(spark, path)), folder)
    assert rows(found, "order_id", "opened_at", "overdue_at", "delays") == [
        ("open", NOON, NOON + dt.timedelta(hours=1), 0),
        ("slow", NOON + dt.timedelta(seconds=60), NOON + dt.timedelta(seconds=600 + 3600), 1),
    ]


def test_overdue_orders_by_timers(spark, raw, folder):
    """The same answers as session windows; late steps join stretches, late payments leave nothing to report."""

    def step(name, at, order):
        return event(name, at, order=order)

    path = _feed(
        raw,
        folder,
        [step("order.created", 0, "paid"), step("order.created", 0, "open"), step("order.created", 60, "slow"), step("order.created", 5, "")],
        [step("order.created", 0, "bridged"), step("order.prep.delayed", 6000, "bridged"), step("order.created", 0, "late")],
        [step("order.prep.delayed", 600, "slow"), step("payment.completed", 900, "paid"), step("order.prep.delayed", 3000, "bridged")],
        [step("payment.completed", 500, "late"), step("order.created", 20_000, "again")],
        _closing(),
    )
    names = ["order_id", "opened_at", "overdue_at", "opened", "delays"]
    with runner.rocksdb_state(spark):
        timers = rows(runner.appended(spark, open_orders.stream_overdue_orders(_stream(spark, path), late="3h"), f"{folder}/timers"), *names)
    sessions = rows(runner.appended(spark, windows.stream_open_orders(_stream(spark, path), late="3h"), f"{folder}/sessions"), *names)
    assert timers == sessions
    assert [r[0] for r in timers] == ["again", "bridged", "open", "slow"]
    assert timers[1][1:] == (NOON, NOON + dt.timedelta(seconds=6000 + 3600), 3, 2)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


@pytest.mark.parametrize("buckets", [1, 3])
def test_overdue_orders_share_a_bucket(spark, raw, folder, buckets):
    """Many orders in one state: joined, paid, reported in several batches and opened again, with one timer at a time."""

    def steps(batch):
        out = []
        for k in range(60):
            at = 7000 * batch + 11 * k
            out.append(event("order.created", at, order=f"o{k}"))
            out.append(event("order.prep.delayed", at + 800 * (k % 5), order=f"o{k}"))
            if (k + batch) % 4 == 0:
                out.append(event("payment.completed", at + 1200, order=f"o{k}"))
        return out

    path = _feed(raw, folder, steps(0), steps(1), steps(2), steps(1)[:9], steps(4), _closing())
    names = ["order_id", "opened_at", "overdue_at", "opened", "delays"]
    with runner.rocksdb_state(spark):
        found = open_orders.stream_overdue_orders(_stream(spark, path), late="5h", buckets=buckets)
        timers = rows(runner.appended(spark, found, f"{folder}/timers"), *names)
    sessions = rows(runner.appended(spark, windows.stream_open_orders(_stream(spark, path), late="5h"), f"{folder}/sessions"), *names)
    assert timers == sessions and len(timers) > 100


def _lines(folder, name, lines):
    Path(f"{folder}/in").mkdir(exist_ok=True)
    Path(f"{folder}/in/{name}.json").write_text("\n".join(lines), encoding="utf-8")


def test_unreadable_lines_are_kept_with_their_load(spark, folder, monkeypatch):
    good = '{"event_time":"2024-01-01T12:00:00Z","event_id":"%s","event_name":"order.created","order_id":"o","payload":{"b":0.90}}'
    _lines(folder, "1", [good % "a", '{"event_time":"2024-01-01T12:00:00Z","event_id":"b"', good % "c"])
    _lines(folder, "2", ['{"event_time":"soon","event_id":"d"}', '{"event_id":"e","payload":{"x":1}}', "", "no json"])
    root, checkpoint = f"{folder}/tables", f"{folder}/checkpoint"

    def land():
        parsed = events.stream_parsed(spark, f"{folder}/in", options=ONE_BY_ONE)
        routes.stream_landing(parsed, root, checkpoint).awaitTermination()

    real, dying = routing.publish_load, [True]

    def publish(*args):
        real(*args)
        if dying:
            dying.clear()
            raise RuntimeError("lost after publishing")

    monkeypatch.setattr(routing, "publish_load", publish)
    try:
        land()
    except Exception as lost:  # noqa: BLE001
        assert "lost after publishing" in str(lost)
    land()  # the first micro-batch runs again under its name
    assert rows(tables.read_table(spark, root, "raw_restaurant_events"), "event_id", "payload") == [("a", '{"b":0.90}'), ("c", '{"b":0.90}')]
    assert tables.read_table(spark, root, "order_events").count() == 2
    kept = rows(tables.read_table(spark, root, QUARANTINE), "reason", "line")
    assert kept == [
        ("no_time", '{"event_id":"e","payload":"{\\"x\\":1}"}'),
        ("unreadable", "no json"),
        ("unreadable", '{"event_time":"2024-01-01T12:00:00Z","event_id":"b"'),
        ("unreadable", '{"event_time":"soon","event_id":"d"}'),
    ]
    files = {r.file.rsplit("/", 1)[1] for r in tables.read_table(spark, root, QUARANTINE).collect()}
    assert files == {"1.json", "2.json"}


def test_rejected_lines_of_a_queue(spark, raw):
    shift = raw(*evening_shift())
    text = spark.createDataFrame([("{}",), ("[1]",), ('{"event_time":"2024-01-01T12:00:00Z","event_id":"x"}',)], "value string")
    landed, rejected = events.landed_and_rejected(events.parsed_lines(text))
    assert rows(landed, "event_id") == [("x",)]
    assert rows(rejected, "file", "reason") == [(None, "no_time"), (None, "unreadable")]
    assert landed.columns == shift.columns


def test_current_orders_stay_few_files(spark, raw, folder):
    """Micro-batch by micro-batch: full levels are merged on the way, the answer stays that of the whole log."""
    shift = evening_shift()
    path = _feed(raw, folder, *[shift[i : i + 1] for i in range(len(shift))])
    orders = routing.route_orders(_stream(spark, path))
    routes.stream_order_states(orders, folder, f"{folder}/checkpoint", merge_every=4).awaitTermination()
    expected = latest_by(routing.route_orders(raw(*shift)), "order_id")
    current = routes.current_orders(spark, folder)
    assert rows(current, "order_id", "event_id") == rows(expected, "order_id", "event_id")
    parts, _ = manifest.state(spark, folder).parts("order_states")
    assert max(p.level for p in parts) >= 1 and all(sum(q.cell == p.cell and q.level == p.level for q in parts) < 8 for p in parts)


def test_rollup_follows_the_stream_and_corrections(spark, raw, folder):
    shift = evening_shift()
    path = _feed(raw, folder, shift[:9], shift[9:])
    routes.stream_route(_stream(spark, path), folder, f"{folder}/checkpoint", rollup=True).awaitTermination()
    as_of = NOON + dt.timedelta(minutes=5)

    def same(events_):
        rolled, whole = tables.read_table(spark, folder, ROLLUP), raw(*events_)
        assert rows(rollups.throughput(rolled)) == rows(dashboard.throughput(whole))
        orders = routing.route_orders(whole)
        assert rows(rollups.station_pressure(rolled, as_of)) == rows(dashboard.station_pressure(orders, as_of))
        assert rollups.orders_today(rolled, as_of).first()[0] == dashboard.orders_today(orders, as_of).first()[0]
        return rolled

    same(shift)
    # another load, then its correction: old counts go with it, and merging changes nothing
    more = [event("order.created", 30 + i, order=f"x{i}", station="grill") for i in range(5)]
    routing.fan_out(raw(*more), folder, "late", also={ROLLUP: rollups.minute_rollup})
    routing.fan_out(raw(*more[:2]), folder, "late", also={ROLLUP: rollups.minute_rollup})
    same(shift + more[:2])
    tables.merge_days(spark, folder, "2024-01-02", (ROLLUP,))
    rolled = same(shift + more[:2])
    # a refresh reads the rollup only
    scans = [f for f in rollups.station_pressure(rolled, as_of).inputFiles()]
    assert scans and all(f"/{ROLLUP}/" in f for f in scans)


def test_delays_without_an_order_go_past_the_join(spark, raw, folder):
    def delay(at, order):
        return event("order.prep.delayed", at, order=order, payload={"delay_minutes": 9, "queue_size": 9})

    def signal(at, order):
        return event("customer.sentiment.signal", at, order=order, payload={"sentiment": "negative", "reason": "r"})

    path = _feed(raw, folder, [delay(0, ""), delay(1, ""), signal(2, ""), signal(3, ""), delay(4, "a"), signal(5, "a")], _closing())
    found = runner.appended(spark, windows.stream_delay_sentiment(_stream(spark, path)), folder).where("order_id <> 'end'")
    assert rows(found, "order_id", "reason") == [("", None), ("", None), ("a", "r")]
