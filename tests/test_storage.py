"""Landing, stored tables, retention and clearing."""

import datetime as dt
import glob
import tempfile

import pytest
from pyspark.sql import functions as F
from conftest import NOON, event, rows
from shift import evening_shift

from opsight.functions import latest_by
from opsight.operators import dashboard, questions, routing
from opsight.plans.catalog import TABLE_QUERIES, raw_events
from opsight.plans.tables import OpsTables
from opsight.schemas import EVENT_TABLES, ORDERS, RAW, TABLE_SCHEMAS
from opsight.sources import events, manifest, stations, tables
from opsight.streaming import routes


def test_json_lines_and_malformed(spark, folder):
    good = '{"event_time":"2024-01-01T12:00:00.5Z","event_id":"a","event_name":"x","payload":{"b":0.90,"a":[1]}}'
    offset = '{"event_time":"2024-01-01T14:00:00+02:00","event_id":"b","event_name":"x","payload":{}}'
    broken = '{"event_time":"2024-01-01T12:00:00Z","event_id":"c"'
    untimed = '{"event_time":"yesterday","event_id":"d"}'
    with open(f"{folder}/in.json", "w", encoding="utf-8") as out:
        out.write("\n".join([good, offset, broken, untimed]))
    landed = {r.event_id: r for r in events.read_raw(spark, folder).collect()}
    assert set(landed) == {"a", "b"}
    assert landed["a"].payload == '{"b":0.90,"a":[1]}'
    assert events.read_raw(spark, folder).where("event_time = timestamp'2024-01-01 12:00:00'").count() == 1
    assert rows(events.read_raw(spark, folder), "event_id") == [("a",), ("b",)]
    assert rows(events.read_malformed(spark, folder), "line") == sorted([(broken,), (untimed,)])


def test_json_round_trip(spark, raw, folder):
    df = raw(*evening_shift())
    events.write_json(df, f"{folder}/json")
    assert rows(events.read_raw(spark, f"{folder}/json")) == rows(df)


def test_conform(spark):
    drifted = spark.createDataFrame(
        [("2024-01-01 12:00:00", "e", "4.0", {"a": 1}, "old"), ("never", "f", "x", None, "old")],
        "event_time string, event_id string, capacity string, payload map<string,int>, stale string",
    )
    fixed = tables.conform(drifted, TABLE_SCHEMAS["kitchen_events"])
    assert fixed.schema.fieldNames() == TABLE_SCHEMAS["kitchen_events"].fieldNames()
    found = sorted((r.event_id, r.event_time, r.capacity, r.station_id, r.payload) for r in fixed.collect())
    assert found == [("e", NOON, 4, None, '{"a":1}'), ("f", None, None, None, None)]


def test_fan_out_is_repeatable_and_answers_match(spark, raw, folder):
    shift = raw(*evening_shift())
    routing.fan_out(shift, folder, 0)
    routing.fan_out(raw(event("order.created", 30, order="o9", station="grill")), folder, 1)
    routing.fan_out(shift, folder, 0)
    stations.write_stations(spark, folder)
    stations.write_stations(spark, folder)
    counts = dict(rows(tables.stored_counts(spark, folder)))
    assert counts["raw_restaurant_events"] == 25 and counts["order_events"] == 19 and counts["stations"] == 4
    t = OpsTables.stored(spark, folder)
    as_of = NOON + dt.timedelta(minutes=1)
    assert dashboard.active_orders(t.orders, as_of).first().Total == 2
    assert questions.active_count(t.orders, as_of).first().Count == 2
    status = dashboard.station_status(t.orders, t.stations, as_of)
    assert rows(status.where("active_orders > 0"), "station_id", "active_orders") == [("grill", 2)]


def test_large_loads_are_routed_from_the_stored_batch(spark, raw, folder):
    shift = raw(*evening_shift())
    routing.fan_out(raw(event("order.created", 30, order="o9", station="grill")), folder, "other")
    for _ in range(2):
        routing.fan_out(shift, folder, "big", from_storage=True)
    for name, route in routing.ROUTES.items():
        if route(shift).count():
            stored = tables.read_table(spark, folder, name, "big").drop("event_date")
            assert rows(stored) == rows(route(shift)), name
    assert tables.read_table(spark, folder, ORDERS).count() == 19


def test_retention_drops_days_only(spark, raw, folder):
    days = [dt.datetime(2024, 1, d, 23, 59) for d in (1, 2, 3)]
    df = raw(*[event("order.created", d, order=str(d.day)) for d in days])
    routing.fan_out(df, folder, "load")
    as_of = dt.datetime(2024, 2, 1, 12)
    assert rows(tables.retain(df, as_of), "order_id") == [("2",), ("3",)]
    kept = glob.glob(f"{folder}/{ORDERS}/event_date=2024-01-0[23]/**/*.parquet", recursive=True)
    dropped = tables.expire(spark, folder, as_of)
    assert sorted(dropped) == [f"{ORDERS}/2024-01-01", f"{RAW}/2024-01-01"]
    assert sorted(kept) == sorted(glob.glob(f"{folder}/{ORDERS}/**/*.parquet", recursive=True))
    assert rows(tables.read_table(spark, folder, ORDERS), "order_id") == [("2",), ("3",)]


def test_clear_keeps_stations(spark, raw, folder):
    routing.fan_out(raw(*evening_shift()), folder, "load")
    stations.write_stations(spark, folder)
    named = tables.clear_tables(spark, folder, dry_run=True)
    assert [n.rsplit("/", 1)[1] for n in named] == list(EVENT_TABLES)
    assert dict(rows(tables.stored_counts(spark, folder)))["raw_restaurant_events"] == 24
    tables.clear_tables(spark, folder)
    counts = dict(rows(tables.stored_counts(spark, folder)))
    assert counts.pop("stations") == 4 and set(counts.values()) == {0}
    routing.fan_out(raw(*evening_shift()), folder, "again")
    assert dict(rows(tables.stored_counts(spark, folder)))["raw_restaurant_events"] == 24


@pytest.fixture(scope="module")
def both(spark):
    """The given events once as derived and once as stored tables."""
    raw = raw_events(spark, "/root/testdata/sf0.001")
    root = tempfile.mkdtemp(prefix="run-stored-")
    routing.fan_out(raw, root, "load")
    stations.write_stations(spark, root)
    return OpsTables.from_raw(raw), OpsTables.stored(spark, root)


@pytest.mark.parametrize("name", [q for q in TABLE_QUERIES if q[0] != "R"])
def test_stored_tables_answer_like_derived_ones(both, name):
    derived, stored = (TABLE_QUERIES[name](tables) for tables in both)
    assert derived.columns == stored.columns
    assert rows(derived) == rows(stored)


def test_reports_end_at_as_of(both):
    for t in both:
        newest = dashboard.delayed_orders(t.orders, "2024-01-02 12:00:00", "6h")
        assert newest.count() and newest.agg({"event_time": "max"}).first()[0] <= dt.datetime(2024, 1, 2, 12)


def test_days_do_not_depend_on_the_session_zone(spark, raw, folder):
    late = raw(event("order.created", dt.datetime(2024, 1, 2, 2, 0), order="1"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        tables.write_table(late, folder, RAW, "load")
        stored = tables.read_table(spark, folder, RAW)
        assert str(stored.first().event_date) == "2024-01-02"
        assert dashboard.orders_today(routing.route_orders(stored), "2024-01-02 18:00:00").first()[0] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_corrected_load_leaves_no_old_days(spark, raw, folder):
    first = event("order.created", dt.datetime(2024, 1, 2, 2, 0), order="1")
    second = event("order.created", dt.datetime(2024, 1, 3, 2, 0), order="2")
    other = event("order.created", dt.datetime(2024, 1, 2, 3, 0), order="3")
    tables.write_table(raw(first, second), folder, RAW, "L")
    tables.write_table(raw(other), folder, RAW, "M")
    tables.write_table(raw(second), folder, RAW, "L")
    assert rows(tables.read_table(spark, folder, RAW), "order_id") == [("2",), ("3",)]
    tables.write_table(raw(second).limit(0), folder, RAW, "L")
    assert rows(tables.read_table(spark, folder, RAW), "order_id") == [("3",)]


def _parts(spark, folder, name):
    return manifest.state(spark, folder).parts(name)[0]


def _seen(spark, folder, name=RAW, column="order_id"):
    return rows(tables.read_table(spark, folder, name), column)


def test_a_load_that_dies_is_invisible_until_its_retry(spark, raw, folder, monkeypatch):
    routing.fan_out(raw(event("order.created", 1, order="old")), folder, "first")
    shift, real, written = raw(*evening_shift()), routing.write_files, []

    def dies(df, root, name, *rest, **options):
        if len(written) >= 3:
            raise RuntimeError("lost")
        written.append(name)
        return real(df, root, name, *rest, **options)

    monkeypatch.setattr(routing, "write_files", dies)
    with pytest.raises(RuntimeError):
        routing.fan_out(shift, folder, "second")
    assert len(written) == 3  # their folders are there, no table shows them
    assert _seen(spark, folder) == [("old",)] and _seen(spark, folder, ORDERS) == [("old",)]
    monkeypatch.setattr(routing, "write_files", real)
    routing.fan_out(shift, folder, "second")
    assert tables.read_table(spark, folder, RAW).count() == 25 and tables.read_table(spark, folder, ORDERS).count() == 19
    removed = manifest.vacuum(spark, folder, EVENT_TABLES, dt.timedelta(0))
    assert {p.split(folder)[1].split("/")[1] for p in removed} == set(written)
    assert tables.read_table(spark, folder, RAW).count() == 25


def test_tables_of_one_state_belong_together(spark, raw, folder):
    routing.fan_out(raw(event("order.created", 1, order="a")), folder, 0)
    before = OpsTables.stored(spark, folder)
    routing.fan_out(raw(event("order.created", 2, order="b")), folder, 1)
    assert before.raw.count() == before.orders.count() == 1
    assert OpsTables.stored(spark, folder).orders.count() == 2


def _many_loads(spark, raw, folder, n, table=RAW, days=1):
    """n loads of one event each, published one by one like micro-batches; written by one job to save time."""
    events_ = [event("order.created", NOON + dt.timedelta(days=i % days, seconds=i), order=f"o{i % 90}") for i in range(n)]
    frame = raw(*events_) if table == RAW else routing.route_orders(raw(*events_))
    stamp, cell = manifest.new_stamp(), "bucket" if table == "order_states" else "event_date"
    number = F.unix_seconds("event_time") % 86_400 - 43_200
    placed = frame.withColumns({
        cell: tables.order_bucket() if cell == "bucket" else F.to_date("event_time"),
        "batch_id": F.concat(F.lit("s-"), number.cast("string"), F.lit(f".{stamp}")),
    })
    placed.repartition("batch_id").write.partitionBy(cell, "batch_id").parquet(f"{folder}/{table}")
    found = manifest.Files(spark, folder).matching(f"{folder}/{table}/*/*/*.parquet")
    loads = {}
    for path, size in found:
        place, load = (p.split("=")[1] for p in path.split("/")[-3:-1])
        loads.setdefault(manifest.split_name(load)[0], {})[place] = [1, size]
    for load, cells in loads.items():
        manifest.publish_load(spark, folder, load, stamp, {table: cells})
    return frame


def test_small_files_of_closed_days_are_merged(spark, raw, folder):
    expected = rows(_many_loads(spark, raw, folder, 500, days=2))
    assert len(_parts(spark, folder, RAW)) == 500
    reader = tables.read_table(spark, folder, RAW)
    assert tables.merge_days(spark, folder, "2024-01-02", (RAW,)) == 1  # the second day is still open
    parts = _parts(spark, folder, RAW)
    assert len(parts) == 251 and sum(p.level for p in parts) == 1
    assert len(glob.glob(f"{folder}/_manifest/*.json")) == 1
    assert rows(reader.drop("event_date")) == expected  # planned before, read after
    assert rows(tables.read_table(spark, folder, RAW).drop("event_date")) == expected
    manifest.vacuum(spark, folder, (RAW,), dt.timedelta(0))
    assert rows(tables.read_table(spark, folder, RAW).drop("event_date")) == expected
    assert len(glob.glob(f"{folder}/{RAW}/event_date=2024-01-01/*/*.parquet")) == 1
    assert tables.merge_days(spark, folder, "2024-01-02", (RAW,)) == 0


def test_corrected_loads_replace_merged_rows(spark, raw, folder):
    for i in range(3):
        tables.write_table(raw(event("order.created", i, order=f"v1-{i}")), folder, RAW, i)
    tables.merge_days(spark, folder, "2024-01-02", (RAW,))
    tables.write_table(raw(event("order.created", 1, order="v2-1")), folder, RAW, 1)
    assert _seen(spark, folder) == [("v1-0",), ("v1-2",), ("v2-1",)]
    assert rows(tables.read_table(spark, folder, RAW, 1), "order_id") == [("v2-1",)]
    assert rows(tables.read_table(spark, folder, RAW, 2), "order_id") == [("v1-2",)]
    assert tables.merge_days(spark, folder, "2024-01-02", (RAW,)) == 1  # masked rows go
    assert manifest.state(spark, folder).parts(RAW)[1] == [] and len(_parts(spark, folder, RAW)) == 1
    assert _seen(spark, folder) == [("v1-0",), ("v1-2",), ("v2-1",)]
    tables.clear_tables(spark, folder)
    assert _seen(spark, folder) == []
    tables.write_table(raw(event("order.created", 1, order="new")), folder, RAW, 1)
    assert _seen(spark, folder) == [("new",)]


def test_two_merges_at_once_count_once(spark, raw, folder, monkeypatch):
    for i in range(4):
        tables.write_table(raw(event("order.created", i, order=str(i))), folder, RAW, i)
    stale = manifest.state(spark, folder)
    tables.merge_days(spark, folder, "2024-01-02", (RAW,))
    monkeypatch.setattr(tables.manifest, "state", lambda *_: stale)  # a second one that saw nothing of the first
    tables.merge_days(spark, folder, "2024-01-02", (RAW,))
    monkeypatch.undo()
    assert _seen(spark, folder) == [("0",), ("1",), ("2",), ("3",)]
    assert len(_parts(spark, folder, RAW)) == 1


def test_bins_and_levels():
    part = [manifest.Part("d", f"p{i}", 0, 1, size, ()) for i, size in enumerate((90, 30, 30, 30, 20, 10))]
    assert [sorted(p.size for p in b) for b in tables.packed_bins(part, 100)] == [[10, 30, 30, 30], ]
    assert tables.packed_bins(part[:2], 100) == []  # one small file alone stays
    runs = [manifest.Part("0", f"r{i}", level, 1, 1, ()) for i, level in enumerate((0, 0, 0, 1, 1))]
    assert [len(g) for g in tables.full_levels(runs, 3)] == [3]


def test_order_states_are_merged_by_level(spark, raw, folder):
    log = _many_loads(spark, raw, folder, 300, "order_states")
    expected = rows(latest_by(log, "order_id"), "order_id", "event_id")
    tables.merge_order_states(spark, folder, 8)
    parts = _parts(spark, folder, "order_states")
    assert len(parts) == tables.BUCKETS and {p.level for p in parts} == {1}
    manifest.vacuum(spark, folder, ("order_states",), dt.timedelta(0))
    current = routes.current_orders(spark, folder)
    assert rows(current, "order_id", "event_id") == expected
    assert len(current.inputFiles()) == len(parts) < 300
    one = routes.current_orders(spark, folder, ["o7"])
    assert rows(one, "order_id", "event_id") == [r for r in expected if r[0] == "o7"]
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    assert routes.current_orders(spark, folder, []).count() == 0


def test_checkpoints_change_nothing(spark, raw, folder):
    for i in range(3):
        tables.write_table(raw(event("order.created", i, order=str(i))), folder, RAW, i)
    tables.expire(spark, folder, "2024-01-30")
    manifest.checkpoint(spark, folder)
    manifest.checkpoint(spark, folder)
    assert _seen(spark, folder) == [("0",), ("1",), ("2",)] and len(glob.glob(f"{folder}/_manifest/*.json")) == 1
    tables.expire(spark, folder, "2024-03-30")
    manifest.checkpoint(spark, folder)
    assert _seen(spark, folder) == []


def test_load_names_that_are_no_folder_names_are_refused(spark, raw, folder):
    with pytest.raises(ValueError):
        tables.write_table(raw(event("order.created", 0)), folder, RAW, "a/b")
