"""What the physical plans must look like at scale."""

import datetime as dt
import re
import tempfile

import pytest
from conftest import NOON
from shift import evening_shift

from opsight.functions import latest_by, lookup
from opsight.operators import actions, dashboard, operational, questions, routing, rules
from opsight.plans.catalog import AS_OF, LOAD, QUERIES, ops_tables
from opsight.plans.rulebook import LARGER_RULES
from opsight.plans.tables import OpsTables
from opsight.schemas import RAW, TABLE_SCHEMAS
from opsight.sources import stations

FOLDER = "/root/testdata/sf0.001"
BATCH = [q for q in QUERIES if q[0] not in "ST" and q != "R8_fan_out"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def details(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", BATCH)
def test_no_python_no_cartesian(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text, node


ROW_WISE = ["R1_route_order", "R2_route_kitchen", "R3_route_inventory", "R4_route_agent", "R5_route_approval",
            "R6_route_action", "A1_delayed_high_queue", "A2_critical_inventory", "X1_action_events",
            "X2_validate_requests"]


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_wise_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["D2_active_orders", "D5_throughput", "C5_compensation", "L1_lifecycle_violations",
                                  "L2_open_orders", "O4_station_saturation", "R7_route_counts"])
def test_one_pre_aggregated_pass(spark, name):
    """Partial and final hash aggregation over one scan, without a join."""
    text = plan(QUERIES[name](spark, FOLDER))
    assert text.count("FileScan") == 1 and "Join" not in text and "SortAggregate" not in text
    assert "partial_" in text


def test_time_filters_reach_the_scan(spark):
    for name in ("D7_station_status", "Q1_sla_risk", "D1_orders_today", "Q8_active_count", "D8_station_pressure"):
        text = plan(QUERIES[name](spark, FOLDER))
        pushed = re.findall(r"PushedFilters: \[([^\]]*)", text)
        assert pushed and all("GreaterThan" in p and "LessThanOrEqual" in p for p in pushed), name


def test_columns_are_pruned(spark):
    text = plan(QUERIES["D1_orders_today"](spark, FOLDER))
    assert "props" not in re.findall(r"ReadSchema: (.*)", text)[0]
    assert "from_json" not in text


@pytest.fixture(scope="module")
def stored(spark):
    root = tempfile.mkdtemp(prefix="run-plans-")
    raw = spark.createDataFrame(evening_shift(), TABLE_SCHEMAS[RAW])
    routing.fan_out(raw, root, "load")
    stations.write_stations(spark, root)
    return OpsTables.stored(spark, root)


def test_stored_tables_prune_days_and_push_filters(stored):
    as_of = NOON + dt.timedelta(minutes=1)
    text = details(dashboard.station_load(stored.orders, as_of))
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", text)
    assert "GreaterThanOrEqual(event_time" in text
    assert "payload" not in re.findall(r"ReadSchema: (.*)", text)[0]
    late = details(operational.delayed_high_queue(stored.orders))
    assert "EqualTo(event_name,order.prep.delayed)" in late and "GreaterThanOrEqual(delay_minutes,5.0)" in late


def test_small_reference_is_broadcast_and_never_the_events(stored):
    text = plan(questions.completed_by_station(stored.orders, stored.stations, NOON + dt.timedelta(minutes=1)))
    assert "BroadcastHashJoin" in text


def test_newest_per_key_is_cut_before_the_shuffle(spark):
    text = plan(latest_by(ops_tables(spark, FOLDER).orders, "order_id"))
    below = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_top_orders_are_taken_before_the_join(spark):
    text = plan(dashboard.delayed_orders(ops_tables(spark, FOLDER).orders, AS_OF, LOAD))
    assert "TakeOrderedAndProject" in text[text.index("Join"):]


@pytest.fixture
def without_broadcast(spark):
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _skewed_log(spark, rows=60_000):
    """Events of which a third belong to one key."""
    return spark.range(0, rows, 1, 8).selectExpr(
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS event_time",
        "concat('e', id) AS event_id",
        "IF(id % 3 = 0, 'hot', concat('k', id % 1000)) AS recommendation_id",
        "concat('filler-', uuid()) AS filler",
        "id",
    )


def test_hot_keys_are_split_in_lookups(spark, without_broadcast):
    log = _skewed_log(spark)
    per_key = log.groupBy("recommendation_id").agg({"id": "min"})
    joined = lookup(log, per_key, "recommendation_id")
    assert joined.count() == 60_000
    done = lookup(log, per_key, "recommendation_id")
    done.write.format("noop").mode("overwrite").save()
    joined = lookup(log, per_key, "recommendation_id")
    joined.collect()
    assert "skew=true" in plan(joined)


def test_hot_recommendation_in_the_approval_gate(spark, without_broadcast):
    log = _skewed_log(spark)
    payload = "to_json(named_struct('recommendation_id', recommendation_id, 'filler', filler)) AS payload"
    action = log.selectExpr(
        "event_time", "event_id", "event_id AS action_id", "'action.x' AS action_type", "'completed' AS action_status",
        "'info' AS severity", payload,
    )
    approval = log.where("id % 2 = 0").selectExpr(
        "event_time", "event_id", "recommendation_id", "'a' AS approver", "'approved' AS approval_status",
        "'info' AS severity", "'' AS payload",
    )
    ungated = actions.ungated_actions(action, approval)
    found = ungated.collect()
    first = {}
    for r in log.where("id % 2 = 0").select("id", "recommendation_id").collect():
        first[r.recommendation_id] = min(r.id, first.get(r.recommendation_id, r.id))
    expected = [r for r in log.select("id", "recommendation_id").collect()
                if r.recommendation_id not in first or first[r.recommendation_id] > r.id]
    assert len(found) == len(expected)
    assert "skew=true" in plan(ungated)


def test_rules_scan_each_source_once(spark, tmp_path):
    """Ten rules on six tables: a scan for each source table, one shuffle, one parse a row."""
    stored = str(tmp_path)
    routing.fan_out(ops_tables(spark, FOLDER).raw, stored, "load")
    text = plan(rules.rule_hits(OpsTables.stored(spark, stored), LARGER_RULES))
    assert text.count("FileScan") == 6 and text.count("Exchange hashpartitioning") == 1
    assert text.count("Generate json_tuple") == 2  # orders and kitchen: the others test no payload
    pushed = re.findall(r"PushedFilters: \[([^\]]*)", text)
    assert sum("event_name" in p or "action_type" in p for p in pushed) == 3  # agent and approval from raw, action
    ranged = plan(rules.rule_hits(OpsTables.stored(spark, stored), LARGER_RULES, AS_OF, "7d"))
    assert ranged.count("PartitionFilters: [isnotnull(event_date") == 6
