"""The registered queries as plain SQL over the source tables, for comparison by another engine.

Written from the table definitions on their own, not generated from the DataFrame code.
"""

from __future__ import annotations

_AS_OF = "TIMESTAMP '2024-01-30 18:00:00'"

# --- fixed values: station rows --------------------------------------------------------------------------------------
_STATION_VALUES = """
  ('grill', 'Plancha / Parrilla', 'Carnes, hamburguesas, filetes', CAST(4 AS BIGINT), CAST(8.0 AS DOUBLE), true),
  ('fryer', 'Freidora', 'Patatas fritas, croquetas, alitas', CAST(4 AS BIGINT), CAST(6.0 AS DOUBLE), true),
  ('sauces', 'Salsas y Aderezos', 'Salsas, ensaladas, preparaciones', CAST(3 AS BIGINT), CAST(3.0 AS DOUBLE), true),
  ('assembly', 'Montaje Final', 'Ensamblaje del plato y empaquetado', CAST(5 AS BIGINT), CAST(2.0 AS DOUBLE), true)
"""

# --- fixed values: alert texts ---------------------------------------------------------------------------------------
_ALERT_TEXTS = {
    "DelayedOrderHighQueue": (
        "Restaurant alert: delayed order with high queue",
        "A delayed order is waiting behind a high station queue. Review the station and reprioritize if needed.",
    ),
    "CriticalInventory": (
        "Restaurant alert: ingredient below threshold",
        "An ingredient has fallen below its threshold. Trigger replenishment or prepare substitutions.",
    ),
    "DeliveryChannelSaturation": (
        "Restaurant alert: delivery channel saturation",
        "Three or more delivery delays were detected in a five-minute window. Consider throttling delivery intake.",
    ),
}
# ---------------------------------------------------------------------------------------------------------------------

_BASE = f"""
WITH src AS (
  SELECT event_id AS n, ts, user_id AS u, event_type, strftime(ts, '%Y%m%d') AS d,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events
), named AS (
  SELECT *,
    CASE event_type
      WHEN 'signup' THEN 'order.created'
      WHEN 'purchase' THEN 'payment.completed'
      WHEN 'error' THEN 'order.prep.delayed'
      WHEN 'view' THEN CASE WHEN n % 2 = 0 THEN 'kitchen.station.updated' ELSE 'inventory.level.changed' END
      ELSE CASE n % 4
        WHEN 0 THEN 'customer.sentiment.signal' WHEN 1 THEN 'agent.recommendation' WHEN 2 THEN 'approval.decision'
        ELSE (['action.reprioritize_order', 'action.restock_ingredient', 'action.reassign_station',
               'action.throttle_channel'])[((u // 12) % 4) + 1] END
    END AS event_name,
    'REC-' || d || '-' || (u % 25) AS rec,
    'ACT-' || n AS act,
    '"is_premium":' || CASE WHEN k % 5 = 0 THEN 'true' ELSE 'false' END
      || ',"cancellation_history":"'
      || (['none', 'cancelado_1_vez', 'cancelado_2_veces', 'cancelado_3_veces'])[(k % 4) + 1]
      || '","feedback":"' || (['muy_negativo', 'negativo', 'neutral', 'positivo'])[((k // 4) % 4) + 1]
      || '","sla_remaining":' || (k % 19) AS customer
  FROM src
), keyed AS (
  SELECT *,
    event_name IN ('kitchen.station.updated') AS kitchen,
    event_name IN ('inventory.level.changed') AS stock
  FROM named
), raw AS (
  SELECT ts AS event_time, 'evt-' || n AS event_id, event_name,
    CASE WHEN event_name IN ('order.created', 'payment.completed', 'order.prep.delayed', 'customer.sentiment.signal')
           THEN 'order'
         WHEN kitchen THEN 'station' WHEN stock THEN 'ingredient'
         WHEN event_name IN ('agent.recommendation', 'approval.decision') THEN 'recommendation'
         ELSE 'action' END AS entity_type,
    CASE WHEN event_name IN ('order.created', 'payment.completed', 'order.prep.delayed', 'customer.sentiment.signal')
           THEN 'ORD-' || d || '-' || u
         WHEN kitchen THEN (['grill', 'fryer', 'sauces', 'assembly'])[((u // 3) % 4) + 1]
         WHEN stock THEN (['beef', 'chicken', 'fries', 'sauce_bbq', 'sauce_mayo'])[(u % 5) + 1]
         WHEN event_name IN ('agent.recommendation', 'approval.decision') THEN rec
         ELSE act END AS entity_id,
    CASE WHEN kitchen OR stock THEN '' ELSE 'ORD-' || d || '-' || u END AS order_id,
    CASE WHEN stock OR event_name = 'customer.sentiment.signal' THEN ''
         ELSE (['grill', 'fryer', 'sauces', 'assembly'])[((u // 3) % 4) + 1] END AS station_id,
    CASE WHEN stock THEN (['beef', 'chicken', 'fries', 'sauce_bbq', 'sauce_mayo'])[(u % 5) + 1] ELSE '' END
      AS ingredient_id,
    CASE WHEN kitchen OR stock THEN '' ELSE (['delivery', 'dine-in', 'takeout'])[(u % 3) + 1] END AS channel,
    CASE WHEN k < 50 THEN 'info' WHEN k < 85 THEN 'warning' ELSE 'critical' END AS severity,
    CASE event_name
      WHEN 'order.created' THEN '{{"order_status":"created",' || customer || ',"items":' || (1 + k % 4) || '}}'
      WHEN 'order.prep.delayed' THEN '{{"order_status":"in_prep","delay_minutes":' || (k % 13) || '.0,"queue_size":'
        || (k % 11) || ',' || customer || '}}'
      WHEN 'payment.completed' THEN '{{"order_status":"completed","amount":' || k || '.5,"payment_method":"card"}}'
      WHEN 'customer.sentiment.signal' THEN '{{"sentiment":"'
        || CASE WHEN k % 2 = 0 THEN 'negative' ELSE 'positive' END || '","reason":"delivery_delay_risk"}}'
      WHEN 'kitchen.station.updated' THEN '{{"station_status":"'
        || CASE WHEN k % 3 = 0 THEN 'saturated' ELSE 'normal' END
        || '","queue_size":' || (k % 11) || ',"capacity":' || (4 + k % 3) || '}}'
      WHEN 'inventory.level.changed' THEN '{{"stock_pct":' || k || '.0,"threshold_pct":'
        || CASE WHEN k % 2 = 0 THEN '20.0' ELSE '15.0' END || ',"delta":-2.5}}'
      WHEN 'agent.recommendation' THEN '{{"recommendation_id":"' || rec || '","priority":' || (1 + k % 5)
        || ',"confidence":0.' || (70 + k % 30) || '}}'
      WHEN 'approval.decision' THEN '{{"recommendation_id":"' || rec || '","approver":"'
        || (['manager_on_duty', 'shift_supervisor', 'auto_approved'])[(k % 3) + 1] || '","approval_status":"'
        || CASE k % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending' ELSE 'approved' END || '"}}'
      ELSE '{{"action_id":"' || act || '","action_status":"' || CASE WHEN k % 10 = 0 THEN 'failed' ELSE 'completed' END
        || '"' || CASE WHEN k % 10 = 1 THEN '' ELSE ',"recommendation_id":"' || rec || '"' END || '}}'
    END AS payload
  FROM keyed
), stations(station_id, display_name, specialization, max_capacity, avg_prep_minutes, is_active) AS (
  VALUES {_STATION_VALUES}
), order_events AS (
  SELECT event_time, event_id, order_id, channel, event_name,
    coalesce(json_extract_string(payload, '$.order_status'), '') AS order_status, station_id,
    TRY_CAST(json_extract_string(payload, '$.delay_minutes') AS DOUBLE) AS delay_minutes, severity, payload
  FROM raw
  WHERE event_name IN ('order.created', 'order.prep.delayed', 'customer.sentiment.signal', 'payment.completed')
), kitchen_events AS (
  SELECT event_time, event_id, station_id,
    CAST(TRY_CAST(json_extract_string(payload, '$.capacity') AS DOUBLE) AS BIGINT) AS capacity, severity, payload
  FROM raw WHERE event_name = 'kitchen.station.updated'
), inventory_events AS (
  SELECT event_time, event_id, ingredient_id,
    TRY_CAST(json_extract_string(payload, '$.stock_pct') AS DOUBLE) AS stock_pct,
    TRY_CAST(json_extract_string(payload, '$.threshold_pct') AS DOUBLE) AS threshold_pct, severity, payload
  FROM raw WHERE event_name = 'inventory.level.changed'
), agent_events AS (
  SELECT event_time, event_id, json_extract_string(payload, '$.recommendation_id') AS recommendation_id, order_id,
    CAST(TRY_CAST(json_extract_string(payload, '$.priority') AS DOUBLE) AS INTEGER) AS priority,
    TRY_CAST(json_extract_string(payload, '$.confidence') AS DOUBLE) AS confidence, severity, payload
  FROM raw WHERE starts_with(lower(event_name), 'agent.')
), approval_events AS (
  SELECT event_time, event_id, json_extract_string(payload, '$.recommendation_id') AS recommendation_id,
    json_extract_string(payload, '$.approver') AS approver,
    coalesce(json_extract_string(payload, '$.approval_status'), '') AS approval_status, severity, payload
  FROM raw WHERE starts_with(lower(event_name), 'approval.')
), action_events AS (
  SELECT event_time, event_id, json_extract_string(payload, '$.action_id') AS action_id, event_name AS action_type,
    json_extract_string(payload, '$.action_status') AS action_status, severity, payload
  FROM raw WHERE starts_with(lower(event_name), 'action.')
)"""

_QUEUE = "CAST(TRY_CAST(json_extract_string(payload, '$.queue_size') AS DOUBLE) AS BIGINT)"


def _bucket(width: str, column: str = "event_time") -> str:
    return f"time_bucket(INTERVAL '{width}', {column}, TIMESTAMP '1970-01-01 00:00:00')"


def _within(lookback: str, column: str = "event_time", op: str = ">=") -> str:
    return f"{column} {op} {_AS_OF} - INTERVAL '{lookback}' AND {column} <= {_AS_OF}"


def _newest(table: str, keys: str, where: str = "true", columns: str = "*") -> str:
    return (
        f"SELECT {columns} FROM {table} WHERE {where} "
        f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY event_time DESC, event_id DESC) = 1"
    )


_OPEN = "order_status NOT IN ('completed', 'cancelled')"

_DELAYED_QUEUE = f"""delayed_queue AS (
  SELECT *, {_QUEUE} AS queue_size FROM order_events
  WHERE event_name = 'order.prep.delayed' AND delay_minutes >= 5 AND {_QUEUE} >= 7)"""

_LOW = "stock_pct <= threshold_pct"

_NEGATIVE = """negative AS (
  SELECT event_time, event_id, order_id, json_extract_string(payload, '$.reason') AS reason FROM order_events
  WHERE event_name = 'customer.sentiment.signal' AND json_extract_string(payload, '$.sentiment') = 'negative')"""

_LOAD = f"""load AS (
  SELECT station_id, count(*) AS active_orders
  FROM ({_newest('order_events', 'order_id, station_id', _within('6 hours'))})
  WHERE {_OPEN} GROUP BY station_id)"""

_KITCHEN_STATE = f"""state AS (
  SELECT station_id, json_extract_string(payload, '$.station_status') AS station_status,
    {_QUEUE} AS reported_queue, severity
  FROM ({_newest('kitchen_events', 'station_id', _within('24 hours'))}))"""

_CRITICAL_NOW = f"""critical_now AS (
  SELECT event_time, ingredient_id, stock_pct, threshold_pct, severity
  FROM ({_newest('inventory_events', 'ingredient_id', _within('7 days'))})
  WHERE stock_pct <= threshold_pct OR stock_pct <= 15)"""

_SATURATED = f"""{_LOAD}, {_KITCHEN_STATE}, measured AS (
  SELECT s.*, coalesce(active_orders, 0) AS queue_size,
    coalesce(nullif(station_status, ''), 'idle') AS station_status, severity
  FROM stations s LEFT JOIN load USING (station_id) LEFT JOIN state USING (station_id)
), saturated AS (
  SELECT * FROM (
    SELECT station_id, display_name, specialization, station_status, queue_size, max_capacity,
      CASE WHEN max_capacity > 0 THEN round(100.0::DOUBLE * queue_size / max_capacity, 1) ELSE 0.0::DOUBLE END
        AS load_pct,
      CASE WHEN queue_size > max_capacity AND avg_prep_minutes > 0
        THEN round((queue_size - max_capacity) * avg_prep_minutes / max_capacity, 1) ELSE 0.0::DOUBLE END
        AS drain_minutes, severity
    FROM measured)
  WHERE load_pct >= 75 OR station_status = 'saturated')"""

_CHAINS = f"""reco AS (
  SELECT recommendation_id, event_time AS rec_time, order_id, priority, confidence, severity
  FROM ({_newest('agent_events', 'recommendation_id', _within('7 days'))})
), appr AS (
  SELECT recommendation_id, event_time AS appr_time, approver, approval_status
  FROM ({_newest('approval_events', 'recommendation_id', _within('7 days'))})
), acted AS (
  SELECT *, coalesce(json_extract_string(payload, '$.recommendation_id'), '') AS recommendation_id
  FROM action_events
), act AS (
  SELECT recommendation_id, event_time AS act_time, action_id, action_type, action_status
  FROM ({_newest('acted', 'recommendation_id', _within('7 days') + " AND recommendation_id <> ''")})
), places AS (
  SELECT order_id, station_id, channel FROM ({_newest('order_events', 'order_id', _within('7 days'))})
)"""

_HITS = f"""{_DELAYED_QUEUE}, hits AS (
  SELECT 'DelayedOrderHighQueue' AS rule, order_id AS key, event_time, CAST(1 AS BIGINT) AS occurrences,
    'action.kitchen.reprioritized' AS action, 'order_id' AS key_field, event_id AS source_event FROM delayed_queue
  UNION ALL
  SELECT 'CriticalInventory', ingredient_id, event_time, CAST(1 AS BIGINT), 'action.restock.triggered',
    'ingredient_id', event_id FROM inventory_events WHERE {_LOW}
  UNION ALL
  SELECT 'DeliveryChannelSaturation', channel, {_bucket('6 hours')}, count(*), 'action.channel.throttled', 'channel', ''
  FROM order_events WHERE event_name = 'order.prep.delayed' AND channel = 'delivery' AND delay_minutes >= 5
  GROUP BY ALL HAVING count(*) >= 3)"""

_TRACE = """trace AS (
  SELECT event_time, event_id, 'agent.recommendation.created' AS event_name, recommendation_id AS entity_id, order_id,
    severity, payload FROM agent_events
  UNION ALL
  SELECT event_time, event_id, 'approval.' || approval_status, recommendation_id, '', severity, payload
  FROM approval_events
  UNION ALL
  SELECT event_time, event_id, action_type, action_id, '', severity, payload FROM action_events)"""

_DAY = f"event_time >= date_trunc('day', {_AS_OF}) AND event_time <= {_AS_OF}"
_LIFECYCLE = "('order.created', 'order.prep.delayed', 'payment.completed')"

_RAW_COLUMNS = (
    "event_time, event_id, event_name, entity_type, entity_id, order_id, station_id, ingredient_id, channel, severity, "
    "payload"
)


def _in_all_tables(with_raw: bool) -> str:
    names = ["order_events", "kitchen_events", "inventory_events", "agent_events", "approval_events", "action_events"]
    parts = [f"SELECT '{t}' AS table_name, event_time, event_id, severity, payload FROM {t}" for t in names]
    if with_raw:
        parts.append("SELECT 'raw_restaurant_events', event_time, event_id, severity, payload FROM raw")
    return " UNION ALL ".join(parts)


def _q(body: str, *parts: str) -> str:
    """The shared mapping, more named steps, and the final select."""
    return ", ".join([_BASE, *parts]) + "\n" + body


_REQUESTS = """
WITH src AS (
  SELECT event_id AS n, ts, user_id AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events
), requests AS (
  SELECT ts AS request_time, 'req-' || n AS request_id,
    (['ReprioritizeOrder', 'TriggerRestock', 'ThrottleChannel', 'IssueCompensation'])[(n % 4) + 1] AS action,
    trim(CASE WHEN n % 4 IN (0, 3) THEN CASE WHEN k % 17 = 0 THEN '  ' ELSE ' ORD-' || u END ELSE '' END) AS order_id,
    CASE WHEN n % 4 = 0 THEN (['grill', 'fryer', 'sauces', 'assembly', 'oven', ''])[(u % 6) + 1] ELSE '' END
      AS station_id,
    CASE WHEN n % 4 = 0 THEN (['normal', 'urgent', 'critical', 'later'])[(k % 4) + 1] ELSE '' END AS priority,
    CASE WHEN k % 13 <> 0 THEN 'delivery_delay_risk' ELSE '' END AS reason,
    CASE WHEN n % 4 = 0 THEN (['manager_on_duty', 'shift_supervisor', 'auto_approved'])[(k % 3) + 1] ELSE '' END
      AS approved_by,
    CASE WHEN n % 4 IN (0, 2) AND k % 7 <> 0 THEN (['delivery', 'dine-in', 'takeout'])[(u % 3) + 1] ELSE '' END
      AS channel,
    CASE WHEN n % 4 IN (0, 1) AND k % 11 <> 0 THEN (['info', 'warning', 'critical'])[(k % 3) + 1] ELSE '' END
      AS severity,
    CASE WHEN n % 4 = 1 THEN (['beef', 'chicken', 'fries', 'sauce_bbq', 'sauce_mayo', 'tomato'])[(u % 6) + 1]
      ELSE '' END AS ingredient_id,
    CASE WHEN n % 4 = 1 THEN CASE WHEN k % 19 = 0 THEN 'low' ELSE (k * 2) || '.5' END ELSE '' END AS stock_pct,
    CASE WHEN n % 4 = 2 THEN CASE WHEN k % 19 = 0 THEN 'soon' ELSE CAST(k % 70 AS VARCHAR) END ELSE '' END AS minutes,
    CASE WHEN n % 4 = 3 THEN (['discount', 'voucher', 'free_item', 'refund'])[(k % 4) + 1] ELSE '' END AS compensation,
    CASE WHEN k % 10 < 5 THEN 'REC-' || (u % 25) ELSE '' END AS recommendation_id
  FROM src
)"""


def _required(column: str, name: str, allowed: str = "") -> str:
    enum = f" WHEN {column} NOT IN ({allowed}) THEN '{name}:enum'" if allowed else ""
    return f"CASE WHEN {column} = '' THEN '{name}:required'{enum} END"


def _ranged(column: str, name: str, kind: str, low: int, high: int) -> str:
    return (
        f"CASE WHEN {column} = '' THEN '{name}:required' WHEN TRY_CAST({column} AS {kind}) IS NULL THEN '{name}:type' "
        f"WHEN TRY_CAST({column} AS DOUBLE) NOT BETWEEN {low} AND {high} THEN '{name}:range' END"
    )


_STATION_ENUM = "'grill', 'fryer', 'sauces', 'assembly'"
_CHANNEL_ENUM = "'delivery', 'dine-in', 'takeout'"


def _watermark(select: str, late: str = "10 minutes") -> str:
    return f"(SELECT max(event_time) FROM {select}) - INTERVAL '{late}'"


def _alert_text(part: int) -> str:
    cases = " ".join(f"WHEN '{rule}' THEN '{both[part]}'" for rule, both in _ALERT_TEXTS.items())
    return f"CASE rule {cases} END"


# the second rule book: name, rows of its source, condition, key, window, minimum
_BOOK = [
    ("LongDelay", "order_events WHERE event_name = 'order.prep.delayed'", "delay_minutes >= 10", "order_id", None, 1),
    ("PremiumDelay", "order_events WHERE true", "json_extract_string(payload, '$.is_premium') = 'true' AND delay_minutes > 6", "order_id", None, 1),
    ("UnhappyChannel", "order_events WHERE event_name = 'customer.sentiment.signal'", "json_extract_string(payload, '$.sentiment') = 'negative'", "channel", "12 hours", 2),
    ("BusyStation", "kitchen_events WHERE true", "CAST(json_extract_string(payload, '$.queue_size') AS DOUBLE) >= 8", "station_id", "1 day", 3),
    ("SmallStation", "kitchen_events WHERE true", "capacity < 5 AND json_extract_string(payload, '$.station_status') = 'saturated'", "station_id", None, 1),
    ("EmptyStock", "inventory_events WHERE true", "stock_pct < 3", "ingredient_id", None, 1),
    ("UrgentAdvice", "agent_events WHERE true", "priority = 1", "recommendation_id", None, 1),
    ("OtherAdvice", "agent_events WHERE false", "true", "recommendation_id", None, 1),
    ("Refused", "approval_events WHERE true", "approval_status = 'rejected'", "approver", "1 day", 2),
    ("FailedThrottle", "action_events WHERE action_type = 'action.throttle_channel'", "action_status = 'failed'", "action_id", None, 1),
]


def _book_hits(bounds: str = "true", columns: str = "rule, key, event_time, occurrences, action, source_event") -> str:
    parts = []
    for name, source, test, key, window, least in _BOOK:
        if window:
            parts.append(
                f"""SELECT '{name}' AS rule, {key} AS key, {_bucket(window)} AS event_time, count(*) AS occurrences, '' AS source_event
                    FROM {source} AND {bounds} AND {test} GROUP BY ALL HAVING count(*) >= {least}"""
            )
        else:
            parts.append(
                f"""SELECT '{name}' AS rule, {key} AS key, event_time, CAST(1 AS BIGINT) AS occurrences, event_id AS source_event
                    FROM {source} AND {bounds} AND {test}"""
            )
    return f"SELECT {columns} FROM (SELECT *, 'action.review.' || rule AS action FROM ({' UNION ALL '.join(parts)}))"


def _book_log() -> str:
    parts = []
    for name, source, test, key, window, least in _BOOK:
        group = key if window else "NULL"
        hits = f"count(*) FILTER (matched >= {least})" if window else "sum(matched)"
        parts.append(
            f"""SELECT '{name}' AS rule, event_time, CAST(sum(evaluated) AS BIGINT) AS evaluated, CAST(sum(matched) AS BIGINT) AS matched,
                  CAST({hits} AS BIGINT) AS hits
                FROM (SELECT {_bucket(window or '5 minutes')} AS event_time, {group} AS k, count(*) AS evaluated,
                        count(*) FILTER ({test}) AS matched FROM {source} GROUP BY ALL) GROUP BY event_time"""
        )
    return " UNION ALL ".join(parts)


def oracle_queries() -> dict[str, str]:
    newest_orders = _newest("order_events", "order_id", _within("6 hours"))
    o2 = _q(
        "SELECT event_time, order_id, channel, station_id, delay_minutes, queue_size, severity FROM delayed_queue",
        _DELAYED_QUEUE,
    )
    o3 = _q(f"SELECT event_time, ingredient_id, stock_pct, threshold_pct, severity FROM inventory_events WHERE {_LOW}")
    o4 = f"""SELECT station_id, {_bucket('5 minutes')} AS event_time, max({_QUEUE}) AS max_queue,
        avg({_QUEUE}) AS avg_queue, count(*) AS events
      FROM kitchen_events GROUP BY ALL HAVING max({_QUEUE}) >= 7 OR avg({_QUEUE}) >= 6"""
    a3 = f"""SELECT {_bucket('6 hours')} AS event_time, channel, count(*) AS delayed_count,
        max(delay_minutes) AS max_delay, 'warning' AS severity
      FROM order_events WHERE event_name = 'order.prep.delayed' AND channel = 'delivery' AND delay_minutes >= 5
      GROUP BY ALL HAVING count(*) >= 3"""
    d5 = f"SELECT {_bucket('1 minute')} AS event_time, event_name, count(*) AS \"Events\" FROM raw GROUP BY ALL"
    raw = _q(f"SELECT {_RAW_COLUMNS} FROM raw")
    hit_key = "rule || '|' || coalesce(key, '') || '|' || epoch_us(event_time) || '|' || coalesce(source_event, '')"
    day_flags = f"""day AS (
      SELECT order_id, bool_or(event_name = 'order.created') AS created,
        bool_or(event_name = 'order.prep.delayed') AS delayed, bool_or(event_name = 'payment.completed') AS paid
      FROM order_events WHERE {_DAY} GROUP BY order_id)"""
    shift = _within("24 hours")
    six_hour_sessions = f"""steps AS (
      SELECT order_id, event_time, event_name,
        CASE WHEN event_time - lag(event_time) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS starts
      FROM raw WHERE event_name IN {_LIFECYCLE}
      WINDOW w AS (PARTITION BY order_id ORDER BY event_time, event_id)
    ), numbered AS (
      SELECT *, sum(starts) OVER (PARTITION BY order_id ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS session
      FROM steps
    )"""
    crowd = f"""crowd AS (
      SELECT {_bucket('6 hours')} AS bucket, channel, count(*) AS c FROM order_events
      WHERE event_name = 'order.prep.delayed' AND delay_minutes >= 5 AND event_time <= {_AS_OF} GROUP BY ALL)"""
    queries = {
        # sources, sinks, table maintenance
        "S1_read_raw": raw,
        "S2_stream_raw": raw,
        "S2_quarantine": _q(
            """SELECT event_id, way,
                 CASE WHEN n % 97 <> 0 AND n % 83 <> 0 AND n % 89 <> 0 THEN 'landed'
                      WHEN way = 'batch' THEN 'rejected'
                      WHEN n % 97 <> 0 AND n % 83 = 0 THEN 'no_time' ELSE 'unreadable' END AS outcome
               FROM (SELECT event_id, CAST(substr(event_id, 5) AS BIGINT) AS n FROM raw), (VALUES ('stream'), ('batch')) w(way)"""
        ),
        "S3_write_tables": _q(_in_all_tables(with_raw=True)),
        "S4_stations": _q(
            """SELECT s.*, c.events FROM stations s
               LEFT JOIN (SELECT station_id, count(*) AS events FROM raw GROUP BY station_id) c USING (station_id)"""
        ),
        "S5_conform_schema": _q(
            f"SELECT * REPLACE (CAST(NULL AS VARCHAR) AS channel) FROM (SELECT {_RAW_COLUMNS} FROM raw)"
        ),
        "S6_clear_tables": _q(
            f"""SELECT table_name, count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after
                FROM ({_in_all_tables(with_raw=True)}) GROUP BY table_name
                UNION ALL SELECT 'stations', count(*), count(*) FROM stations"""
        ),
        "S7_retention": _q(f"SELECT {_RAW_COLUMNS} FROM raw WHERE event_time >= TIMESTAMP '2024-01-16 00:00:00'"),
        # routing
        "R1_route_order": _q("SELECT * FROM order_events"),
        "R2_route_kitchen": _q("SELECT * FROM kitchen_events"),
        "R3_route_inventory": _q("SELECT * FROM inventory_events"),
        "R4_route_agent": _q("SELECT * FROM agent_events"),
        "R5_route_approval": _q("SELECT * FROM approval_events"),
        "R6_route_action": _q("SELECT * FROM action_events"),
        "R7_route_counts": _q(
            f"""SELECT target, count(table_name) AS "rows"
                FROM (VALUES ('order_events'), ('kitchen_events'), ('inventory_events'), ('agent_events'),
                  ('approval_events'), ('action_events'), ('unrouted')) v(target)
                LEFT JOIN (SELECT table_name FROM ({_in_all_tables(with_raw=False)})
                  UNION ALL
                  SELECT 'unrouted' FROM raw WHERE event_id NOT IN (
                    SELECT event_id FROM ({_in_all_tables(with_raw=False)}))) ON table_name = target
                GROUP BY target"""
        ),
        "R8_fan_out": _q(_in_all_tables(with_raw=False)),
        # operational
        "O1_raw_timeline": _q(
            """SELECT event_time, event_name, entity_type, entity_id, order_id, station_id, ingredient_id, channel,
               severity, payload FROM raw"""
        ),
        "O2_delayed_high_queue": o2,
        "O3_critical_inventory": o3,
        "O4_station_saturation": _q(o4),
        "O5_agent_review": _q(
            """SELECT q.event_time AS delay_time, q.order_id, channel, station_id, delay_minutes, queue_size,
                 CASE WHEN n.order_id IS NOT NULL THEN 'negative' END AS sentiment, reason
               FROM delayed_queue q LEFT JOIN negative n ON q.order_id = n.order_id
               WHERE n.order_id IS NOT NULL OR delay_minutes >= 8""",
            _DELAYED_QUEUE,
            _NEGATIVE,
        ),
        "O5_agent_review_counts": _q(
            """SELECT q.event_time AS delay_time, q.order_id, channel, station_id, delay_minutes, queue_size, reason,
                 coalesce(signals, 0) AS negative_signals
               FROM delayed_queue q LEFT JOIN
                 (SELECT order_id, reason, count(*) AS signals FROM negative GROUP BY ALL) n ON q.order_id = n.order_id
               WHERE signals IS NOT NULL OR delay_minutes >= 8""",
            _DELAYED_QUEUE,
            _NEGATIVE,
        ),
        "O6_trace_union": _q("SELECT * EXCLUDE (event_id) FROM trace", _TRACE),
        # dashboard
        "D1_orders_today": _q(
            f"""SELECT count(DISTINCT order_id) AS "Total" FROM order_events
                WHERE {_DAY} AND event_name = 'order.created'"""
        ),
        "D2_active_orders": _q(
            f"""SELECT count(DISTINCT order_id) AS "Total" FROM order_events
                WHERE {_DAY} AND event_name = 'order.created' AND order_id NOT IN (
                  SELECT order_id FROM order_events WHERE {_DAY} AND event_name = 'payment.completed')"""
        ),
        "D3_completed_today": _q(
            f"""SELECT count(DISTINCT order_id) AS "Total" FROM order_events
                WHERE {_DAY} AND event_name = 'payment.completed' AND order_id IN (
                  SELECT order_id FROM order_events WHERE {_DAY} AND event_name = 'order.created')"""
        ),
        "D4_completed_with_delay": _q(
            'SELECT count(*) AS "Total" FROM day WHERE created AND delayed AND paid', day_flags
        ),
        "D5_throughput": _q(d5),
        "D6_delayed_orders": _q(
            f"""SELECT event_time, order_id, channel, o.station_id, delay_minutes,
                 coalesce(active_orders, 0) AS active_orders, severity
               FROM order_events o LEFT JOIN load ON load.station_id = o.station_id
               WHERE event_name = 'order.prep.delayed' AND event_time <= {_AS_OF} ORDER BY event_time DESC, event_id DESC LIMIT 50""",
            _LOAD,
        ),
        "D7_station_status": _q(
            """SELECT station_id, display_name, specialization,
                 CASE WHEN load_pct >= 100 THEN 'saturated' WHEN load_pct >= 75 THEN 'busy'
                      WHEN active_orders > 0 THEN 'active' ELSE 'idle' END AS station_status,
                 active_orders, queue_size, max_capacity, load_pct,
                 CASE WHEN queue_size > 0 AND avg_prep_minutes > 0
                   THEN round(queue_size * avg_prep_minutes / max_capacity, 1) ELSE 0.0::DOUBLE END AS drain_minutes,
                 CASE WHEN load_pct >= 100 THEN 'critical' WHEN load_pct >= 75 THEN 'warning' ELSE 'info' END
                   AS severity
               FROM (SELECT s.*, coalesce(active_orders, 0) AS active_orders,
                       greatest(0, coalesce(active_orders, 0) - max_capacity) AS queue_size,
                       CASE WHEN max_capacity > 0
                         THEN round(100.0::DOUBLE * coalesce(active_orders, 0) / max_capacity, 1)
                         ELSE 0.0::DOUBLE END AS load_pct
                     FROM stations s LEFT JOIN load USING (station_id))""",
            _LOAD,
        ),
        "D8_station_pressure": _q(
            f"""SELECT station_id, {_bucket('5 minutes')} AS event_time,
                  count(*) FILTER (event_name = 'order.created') AS "Created",
                  count(*) FILTER (event_name = 'order.prep.delayed') AS "Delayed",
                  count(*) FILTER (event_name = 'payment.completed') AS "Completed"
                FROM order_events WHERE {_within('24 hours', op='>')} AND station_id <> '' GROUP BY ALL"""
        ),
        "D9_critical_inventory_last": _q(
            _newest(
                "inventory_events",
                "ingredient_id",
                _LOW,
                "event_time, ingredient_id, stock_pct, threshold_pct, severity",
            )
        ),
        "D10_trace_top100": _q(
            f"""SELECT * EXCLUDE (event_id) FROM (
                 SELECT * FROM trace WHERE event_time <= {_AS_OF} ORDER BY event_time DESC, event_id DESC LIMIT 100)""",
            _TRACE,
        ),
        # alert rules
        "A1_delayed_high_queue": o2,
        "A2_critical_inventory": o3,
        "A3_channel_saturation": _q(a3),
        "A3_channel_saturation_sliding": _q(
            """SELECT make_timestamp(second * 1000000) AS event_time, channel, CAST(delayed_count AS BIGINT)
                 AS delayed_count, max_delay, 'warning' AS severity
               FROM (SELECT channel, second,
                       sum(n) OVER w AS delayed_count, max(worst) OVER w AS max_delay
                     FROM per_second WINDOW w AS (
                       PARTITION BY channel ORDER BY second RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW))
               WHERE delayed_count >= 3""",
            """per_second AS (
               SELECT channel, epoch_us(event_time) // 1000000 AS second, count(*) AS n, max(delay_minutes) AS worst
               FROM order_events WHERE event_name = 'order.prep.delayed' AND channel = 'delivery' AND delay_minutes >= 5
               GROUP BY ALL)""",
        ),
        "A4_rules_from_config": _q("SELECT * EXCLUDE (key_field, source_event) FROM hits", _HITS),
        "A4_larger_book": _q(_book_hits()),
        "A4_rules_in_range": _q(_book_hits(_within("7 days"), "rule, key, event_time, occurrences, action")),
        "A5_alert_actions": _q(
            f"""SELECT event_time, 'evt-' || digest AS event_id, action AS event_name, 'action' AS entity_type,
                  'act-' || digest AS entity_id,
                  CASE WHEN key_field = 'order_id' THEN key ELSE '' END AS order_id,
                  CASE WHEN key_field = 'station_id' THEN key ELSE '' END AS station_id,
                  CASE WHEN key_field = 'ingredient_id' THEN key ELSE '' END AS ingredient_id,
                  CASE WHEN key_field = 'channel' THEN key ELSE '' END AS channel, 'warning' AS severity,
                  '{{"action_id":"act-' || digest || '","action_status":"triggered","action_type":"' || action
                    || '","rule":"' || rule || '"}}' AS payload
                FROM (SELECT *, substr(sha256({hit_key}), 1, 32) AS digest FROM hits)""",
            _HITS,
        ),
        "A6_alert_messages": _q(
            f"SELECT rule, key, event_time, {_alert_text(0)} AS headline, {_alert_text(1)} AS message FROM hits", _HITS
        ),
        # questions
        "Q1_sla_risk": _q(
            """SELECT event_time, order_id, channel, r.station_id, display_name, specialization, delay_minutes,
                 sla_remaining, risk_score, order_status, severity
               FROM risk r LEFT JOIN stations s ON s.station_id = r.station_id
               ORDER BY risk_score DESC, delay_minutes DESC NULLS LAST, sla_remaining ASC NULLS FIRST, order_id
               LIMIT 20""",
            f"""risk AS (
               SELECT *, CAST(
                   CASE WHEN delay_minutes >= 10 THEN 3 WHEN delay_minutes >= 5 THEN 2 ELSE 1 END
                   + CASE WHEN sla_remaining <= 5 THEN 2 WHEN sla_remaining <= 10 THEN 1 ELSE 0 END AS BIGINT)
                   AS risk_score
               FROM (SELECT *, TRY_CAST(json_extract_string(payload, '$.sla_remaining') AS DOUBLE) AS sla_remaining
                     FROM ({newest_orders}) WHERE order_id <> '' AND {_OPEN}))""",
        ),
        "Q2_saturated_stations": _q("SELECT * FROM saturated", _SATURATED),
        "Q3_critical_now": _q("SELECT * FROM critical_now", _CRITICAL_NOW),
        "Q4_pending_recommendations": _q(
            """SELECT recommendation_id, order_id, channel, station_id, display_name, specialization, priority,
                 confidence, severity, rec_time
               FROM reco LEFT JOIN appr USING (recommendation_id) LEFT JOIN places USING (order_id)
               LEFT JOIN stations USING (station_id)
               WHERE approval_status IS NULL OR approval_status NOT IN ('approved', 'rejected')""",
            _CHAINS,
        ),
        "Q5_full_trace": _q(
            """SELECT recommendation_id, order_id, channel, station_id, display_name, specialization, priority,
                 confidence, approval_status, approver, action_type, action_status, rec_time, appr_time, act_time
               FROM reco LEFT JOIN appr USING (recommendation_id) LEFT JOIN act USING (recommendation_id)
               LEFT JOIN places USING (order_id) LEFT JOIN stations USING (station_id)""",
            _CHAINS,
        ),
        "Q6_completed_by_station": _q(
            f"""SELECT event_time, station_id, display_name, specialization, completed
                FROM (SELECT station_id, {_bucket('10 minutes')} AS event_time, count(*) AS completed
                      FROM order_events WHERE {_within('24 hours')} AND order_status = 'completed' GROUP BY ALL)
                LEFT JOIN stations USING (station_id)"""
        ),
        "Q7_active_by_station": _q(
            f"""SELECT station_id, display_name, specialization, queue_size
                FROM (SELECT station_id, count(*) AS queue_size FROM ({newest_orders}) WHERE {_OPEN}
                      GROUP BY station_id)
                LEFT JOIN stations USING (station_id)"""
        ),
        "Q8_active_count": _q(f'SELECT count(*) AS "Count" FROM ({newest_orders}) WHERE {_OPEN}'),
        # several signals
        "C1_sla_risk_customer": _q(
            """SELECT *, concat_ws(',', CASE WHEN negative_sentiment THEN 'negative_sentiment' END,
                   CASE WHEN negative_feedback THEN 'negative_feedback' END,
                   CASE WHEN cancelled_before THEN 'cancelled_before' END,
                   CASE WHEN is_premium THEN 'is_premium' END) AS reasons,
                 'ReprioritizeOrder' AS recommended_action
               FROM (SELECT event_time, event_id, order_id, channel, station_id, delay_minutes,
                       TRY_CAST(json_extract_string(payload, '$.sla_remaining') AS DOUBLE) AS sla_remaining,
                       order_id IN (SELECT order_id FROM negative) AS negative_sentiment,
                       json_extract_string(payload, '$.feedback') IN ('negativo', 'muy_negativo') AS negative_feedback,
                       json_extract_string(payload, '$.cancellation_history') <> 'none' AS cancelled_before,
                       json_extract_string(payload, '$.is_premium') = 'true' AS is_premium
                     FROM order_events WHERE event_name = 'order.prep.delayed' AND delay_minutes >= 5)
               WHERE sla_remaining <= 10
                 AND (negative_sentiment OR negative_feedback OR cancelled_before OR is_premium)""",
            _NEGATIVE,
        ),
        "C2_station_bottleneck": _q(
            """SELECT station_id, display_name, coalesce(active_orders, 0) AS active_orders, max_capacity,
                 reported_queue, delayed_orders, stock AS critical_stock_present,
                 CASE WHEN stock THEN 'critical' ELSE 'urgent' END AS priority,
                 'ReprioritizeOrder' AS recommended_action
               FROM (SELECT *, (SELECT count(*) > 0 FROM critical_now) AS stock FROM stations)
               LEFT JOIN load USING (station_id) LEFT JOIN (SELECT station_id, reported_queue FROM state)
                 USING (station_id)
               JOIN late USING (station_id)
               WHERE coalesce(active_orders, 0) > max_capacity OR reported_queue >= 7""",
            _LOAD,
            _KITCHEN_STATE,
            _CRITICAL_NOW,
            f"""late AS (
               SELECT station_id, count(*) AS delayed_orders FROM order_events
               WHERE event_name = 'order.prep.delayed' AND delay_minutes >= 5 AND event_time <= {_AS_OF}
               GROUP BY station_id)""",
        ),
        "C3_signal_correlation": _q(
            f"""SELECT *, CAST(is_delayed AS INTEGER) + CAST(station_saturated AS INTEGER) + CAST(low_stock AS INTEGER)
                  + CAST(channel_accumulating AS INTEGER) + CAST(negative_sentiment AS INTEGER) AS signal_count
                FROM (SELECT event_time, event_id, order_id, channel, station_id, delay_minutes,
                        coalesce(delay_minutes >= 5, false) AS is_delayed,
                        station_id IN (SELECT station_id FROM saturated) AS station_saturated,
                        (SELECT count(*) > 0 FROM critical_now) AS low_stock,
                        EXISTS (SELECT 1 FROM crowd c WHERE c.bucket = {_bucket('6 hours', 'o.event_time')}
                                AND c.channel = o.channel AND c.c >= 3) AS channel_accumulating,
                        order_id IN (SELECT order_id FROM negative WHERE event_time <= {_AS_OF}) AS negative_sentiment
                      FROM order_events o WHERE event_name = 'order.prep.delayed' AND event_time <= {_AS_OF})""",
            _SATURATED,
            _CRITICAL_NOW,
            _NEGATIVE,
            crowd,
        ),
        "C4_delay_over_capacity": _q(
            f"""SELECT event_time, event_id, order_id, channel, o.station_id, display_name, delay_minutes,
                  active_orders, max_capacity
                FROM order_events o JOIN load ON load.station_id = o.station_id
                JOIN stations s ON s.station_id = o.station_id
                WHERE event_name = 'order.prep.delayed' AND delay_minutes >= 5 AND event_time <= {_AS_OF}
                  AND active_orders > max_capacity""",
            _LOAD,
        ),
        "C5_compensation": _q(
            """SELECT l.order_id, delays, max_delay, last_delay, negative_signals, last_signal,
                 'action.compensation.issued' AS action
               FROM (SELECT order_id, count(*) AS delays, max(delay_minutes) AS max_delay,
                       max(event_time) AS last_delay
                     FROM order_events WHERE event_name = 'order.prep.delayed' AND delay_minutes >= 5
                     GROUP BY order_id) l
               JOIN (SELECT order_id, count(*) AS negative_signals, max(event_time) AS last_signal
                     FROM negative GROUP BY order_id) n ON l.order_id = n.order_id""",
            _NEGATIVE,
        ),
        # actions
        "X1_action_events": _REQUESTS
        + """SELECT request_time AS event_time, 'evt-' || digest AS event_id,
               'action.kitchen.reprioritized' AS event_name, 'action' AS entity_type, 'act-' || digest AS entity_id,
               order_id, station_id, '' AS ingredient_id,
               CASE WHEN channel = '' THEN 'delivery' ELSE channel END AS channel,
               CASE WHEN severity = '' THEN 'warning' ELSE severity END AS severity,
               '{"action_id":"act-' || digest || '","action_status":"approved","priority":"' || priority
                 || '","reason":"' || reason || '","approved_by":"' || approved_by || '"'
                 || CASE WHEN recommendation_id = '' THEN ''
                         ELSE ',"recommendation_id":"' || recommendation_id || '"' END || '}' AS payload
             FROM (SELECT *, substr(sha256(request_id || '|' || order_id || '|' || station_id), 1, 32) AS digest
                   FROM requests WHERE action = 'ReprioritizeOrder' AND order_id <> '' AND station_id <> '')""",
        "X2_validate_requests": _REQUESTS
        + f"""SELECT request_id, action, errors = '' AS valid, errors FROM (
               SELECT request_id, action, CASE action
                 WHEN 'ReprioritizeOrder' THEN concat_ws(';', {_required('order_id', 'orderId')},
                   {_required('station_id', 'stationId', _STATION_ENUM)},
                   {_required('priority', 'priority', "'normal', 'urgent', 'critical'")},
                   {_required('reason', 'reason')}, {_required('approved_by', 'approvedBy')},
                   {_required('channel', 'channel', _CHANNEL_ENUM)},
                   {_required('severity', 'severity', "'info', 'warning', 'critical'")})
                 WHEN 'TriggerRestock' THEN concat_ws(';',
                   {_required('ingredient_id', 'ingredientId', "'beef', 'chicken', 'fries', 'sauce_bbq', 'sauce_mayo'")},
                   {_ranged('stock_pct', 'stockPct', 'DOUBLE', 0, 100)}, {_required('reason', 'reason')},
                   {_required('severity', 'severity', "'warning', 'critical'")})
                 WHEN 'ThrottleChannel' THEN concat_ws(';', {_required('channel', 'channel', _CHANNEL_ENUM)},
                   {_ranged('minutes', 'durationMinutes', 'INTEGER', 1, 60)}, {_required('reason', 'reason')})
                 WHEN 'IssueCompensation' THEN concat_ws(';', {_required('order_id', 'orderId')},
                   {_required('compensation', 'compensationType', "'discount', 'voucher', 'free_item'")},
                   {_required('reason', 'reason')})
               END AS errors FROM requests)""",
        "X3_human_gate": _q(
            """SELECT event_time, event_id, action_id, action_type, action_status, a.recommendation_id, first_approved
               FROM (SELECT *, coalesce(json_extract_string(payload, '$.recommendation_id'), '') AS recommendation_id
                     FROM action_events) a
               LEFT JOIN (SELECT recommendation_id, min(event_time) AS first_approved FROM approval_events
                          WHERE approval_status = 'approved' AND recommendation_id <> '' GROUP BY recommendation_id) f
                 ON f.recommendation_id = a.recommendation_id
               WHERE first_approved IS NULL OR first_approved > event_time"""
        ),
        # lifecycle, quality, evidence
        "L1_lifecycle_violations": _q(
            """SELECT *, concat_ws(',', CASE WHEN created = 0 THEN 'not_created' END,
                   CASE WHEN created > 1 THEN 'created_again' END, CASE WHEN delayed > 1 THEN 'delayed_again' END,
                   CASE WHEN paid > 1 THEN 'paid_again' END,
                   CASE WHEN first_other < first_created THEN 'step_before_created' END) AS problems
               FROM per_order
               WHERE created <> 1 OR delayed > 1 OR paid > 1 OR coalesce(first_other < first_created, false)""",
            f"""per_order AS (
               SELECT order_id, count(*) FILTER (event_name = 'order.created') AS created,
                 count(*) FILTER (event_name = 'order.prep.delayed') AS delayed,
                 count(*) FILTER (event_name = 'payment.completed') AS paid,
                 min(event_time) FILTER (event_name = 'order.created') AS first_created,
                 min(event_time) FILTER (event_name <> 'order.created') AS first_other
               FROM order_events WHERE event_name IN {_LIFECYCLE} GROUP BY order_id)""",
        ),
        "L2_open_orders": _q(
            f"""SELECT order_id, opened_at, CASE WHEN delays > 0 THEN 'delayed' ELSE 'created' END AS state,
                  date_sub('second', opened_at, {_AS_OF}) AS age_seconds
                FROM (SELECT order_id, min(event_time) AS opened_at,
                        count(*) FILTER (event_name = 'order.prep.delayed') AS delays
                      FROM order_events
                      WHERE event_name IN ('order.created', 'order.prep.delayed') AND event_time <= {_AS_OF}
                        AND order_id NOT IN (SELECT order_id FROM order_events
                                             WHERE event_name = 'payment.completed' AND event_time <= {_AS_OF})
                      GROUP BY order_id)"""
        ),
        "L3_state_summary": _q(
            f"""SELECT 'order_state' AS kind, CASE event_name WHEN 'order.created' THEN 'created'
                  WHEN 'order.prep.delayed' THEN 'delayed' ELSE 'completed' END AS name, count(*) AS total
                FROM ({_newest('order_events', 'order_id', 'event_name IN ' + _LIFECYCLE)}) GROUP BY ALL
                UNION ALL
                SELECT 'event_name', event_name, count(*) FROM raw GROUP BY ALL"""
        ),
        "L4_shift_summary": _q(
            f"""SELECT metric, coalesce(max(total), 0)::BIGINT AS total FROM (VALUES ('completed_on_time'),
                  ('completed_with_delay'), ('delays_mitigated'), ('actions_executed')) v(metric) LEFT JOIN (
                SELECT CASE WHEN first_delay IS NULL THEN 'completed_on_time' ELSE 'completed_with_delay' END AS metric,
                  count(*) AS total FROM per_order GROUP BY ALL
                UNION ALL
                SELECT 'delays_mitigated', count(DISTINCT order_id) FROM per_order p
                WHERE EXISTS (SELECT 1 FROM raw r WHERE r.order_id = p.order_id AND {shift}
                  AND event_name IN ('action.kitchen.reprioritized', 'action.reprioritize_order')
                  AND r.event_time > p.first_delay AND r.event_time < p.last_paid) HAVING count(*) > 0
                UNION ALL
                SELECT 'actions_executed', count(*) FROM raw
                WHERE {shift} AND starts_with(lower(event_name), 'action.')) USING (metric) GROUP BY metric""",
            f"""per_order AS (
               SELECT order_id, min(event_time) FILTER (event_name = 'order.prep.delayed') AS first_delay,
                 max(event_time) FILTER (event_name = 'payment.completed') AS last_paid
               FROM raw WHERE {shift} AND event_name IN {_LIFECYCLE} GROUP BY order_id
               HAVING count(*) FILTER (event_name = 'order.created') > 0
                 AND max(event_time) FILTER (event_name = 'payment.completed') IS NOT NULL)""",
        ),
        "L5_larger_book": _q(_book_log()),
        "L5_rule_log": _q(
            f"""SELECT 'DelayedOrderHighQueue' AS rule, {_bucket('5 minutes')} AS event_time, count(*) AS evaluated,
                  count(*) FILTER (delay_minutes >= 5 AND {_QUEUE} >= 7) AS matched,
                  count(*) FILTER (delay_minutes >= 5 AND {_QUEUE} >= 7) AS hits
                FROM order_events WHERE event_name = 'order.prep.delayed' GROUP BY ALL
                UNION ALL
                SELECT 'CriticalInventory', {_bucket('5 minutes')}, count(*), count(*) FILTER ({_LOW}),
                  count(*) FILTER ({_LOW}) FROM inventory_events GROUP BY ALL
                UNION ALL
                SELECT 'DeliveryChannelSaturation', event_time, CAST(sum(evaluated) AS BIGINT),
                  CAST(sum(matched) AS BIGINT), count(*) FILTER (matched >= 3)
                FROM (SELECT {_bucket('6 hours')} AS event_time, channel, count(*) AS evaluated,
                        count(*) FILTER (channel = 'delivery' AND delay_minutes >= 5) AS matched
                      FROM order_events WHERE event_name = 'order.prep.delayed' GROUP BY ALL)
                GROUP BY event_time"""
        ),
        "L6_chain_latency": _q(
            """SELECT recommendation_id, rec_time, appr_time, act_time,
                 (epoch_us(appr_time) - epoch_us(rec_time)) / 1e6::DOUBLE AS decision_seconds,
                 (epoch_us(act_time) - epoch_us(appr_time)) / 1e6::DOUBLE AS action_seconds,
                 (epoch_us(act_time) - epoch_us(rec_time)) / 1e6::DOUBLE AS total_seconds
               FROM reco JOIN appr USING (recommendation_id) JOIN act USING (recommendation_id)""",
            _CHAINS,
        ),
        # streams: what has come out once the watermark has passed
        "T1_stream_route": _q(_in_all_tables(with_raw=False)),
        "T2_stream_throughput": _q(
            f"SELECT * FROM ({d5}) WHERE event_time + INTERVAL '1 minute' <= {_watermark('raw')}"
        ),
        "T3_stream_saturation": _q(
            f"""SELECT * FROM ({o4})
                WHERE event_time + INTERVAL '5 minutes' <= {_watermark('kitchen_events')}"""
        ),
        "T4_stream_channel_saturation": _q(
            f"SELECT * FROM ({a3}) WHERE event_time + INTERVAL '6 hours' <= {_watermark('raw')}"
        ),
        "T5_stream_latest_order": _q(
            _newest("order_events", "order_id", "true", "order_id, event_time, event_id, event_name, order_status")
        ),
        "T6_stream_delay_sentiment": _q(
            f"""SELECT q.event_time AS delay_time, q.order_id, channel, station_id, delay_minutes, queue_size,
                  n.event_time AS signal_time, reason
                FROM delayed_queue q LEFT JOIN negative n ON q.order_id = n.order_id
                  AND n.event_time BETWEEN q.event_time - INTERVAL '6 hours' AND q.event_time + INTERVAL '6 hours'
                WHERE n.order_id IS NOT NULL OR q.event_time + INTERVAL '6 hours' < least(
                  {_watermark("order_events WHERE event_name = 'order.prep.delayed' AND delay_minutes >= 5")},
                  {_watermark("order_events WHERE event_name = 'customer.sentiment.signal'")})""",
            _DELAYED_QUEUE,
            _NEGATIVE,
        ),
        "T7_stream_alerts_once": _q(
            f"""SELECT event_time, event_id, 'DelayedOrderHighQueue' AS rule, order_id AS key FROM delayed_queue
                UNION ALL
                SELECT event_time, event_id, 'CriticalInventory', ingredient_id FROM inventory_events WHERE {_LOW}""",
            _DELAYED_QUEUE,
        ),
        "T8_stream_open_orders": _q(
            f"""SELECT order_id, min(event_time) AS opened_at, max(event_time) + INTERVAL '6 hours' AS overdue_at,
                  count(*) FILTER (event_name <> 'payment.completed') AS opened,
                  count(*) FILTER (event_name = 'order.prep.delayed') AS delays
                FROM numbered GROUP BY order_id, session
                HAVING count(*) FILTER (event_name = 'payment.completed') = 0
                  AND max(event_time) + INTERVAL '6 hours' <= {_watermark('steps')}""",
            six_hour_sessions,
        ),
    }
    queries["D5_throughput_rollup"] = queries["D5_throughput"]
    queries["D8_station_pressure_rollup"] = queries["D8_station_pressure"]
    queries["D1_distinct_sketch"] = _q(
        """SELECT CAST(event_time AS DATE) AS day, count(DISTINCT order_id) AS exact, true AS within_bound
           FROM order_events WHERE event_name = 'order.created' GROUP BY ALL"""
    )
    queries["T7_stream_rules"] = queries["A4_larger_book"]
    queries["A4_polled_rules"] = queries["A4_larger_book"]
    requests, checked = queries["X2_validate_requests"].split("SELECT request_id, action, errors = ", 1)
    event_of = """CASE action WHEN 'ReprioritizeOrder' THEN 'action.kitchen.reprioritized'
      WHEN 'TriggerRestock' THEN 'action.restock.triggered' WHEN 'ThrottleChannel' THEN 'action.channel.throttled'
      ELSE 'action.compensation.issued' END"""
    queries["X1_action_loop"] = f"""{requests}
      SELECT request_time AS event_time, 'evt-' || digest AS event_id, 'act-' || digest AS action_id, {event_of} AS action_type,
        'approved' AS action_status, CASE WHEN action IN ('ReprioritizeOrder', 'TriggerRestock') THEN severity ELSE 'warning' END AS severity,
        '{{"action_id":"act-' || digest || '","action_status":"approved",'
          || CASE WHEN action = 'ReprioritizeOrder' THEN '"priority":"' || priority || '",' ELSE '' END || '"reason":"' || reason || '"'
          || CASE WHEN action = 'ReprioritizeOrder' THEN ',"approved_by":"' || approved_by || '"' ELSE '' END
          || CASE WHEN recommendation_id = '' THEN '' ELSE ',"recommendation_id":"' || recommendation_id || '"' END
          || CASE action WHEN 'TriggerRestock' THEN ',"stock_pct":' || CAST(stock_pct AS DOUBLE)
               WHEN 'ThrottleChannel' THEN ',"duration_minutes":' || minutes
               WHEN 'IssueCompensation' THEN ',"compensation_type":"' || compensation || '"' ELSE '' END || '}}' AS payload
      FROM (SELECT r.*, substr(sha256(CASE action
                WHEN 'ReprioritizeOrder' THEN request_id || '|' || order_id || '|' || station_id
                WHEN 'TriggerRestock' THEN request_id || '|' || action || '||' || ingredient_id || '|'
                WHEN 'ThrottleChannel' THEN request_id || '|' || action || '|||' || channel
                ELSE request_id || '|' || action || '|' || order_id || '||' END), 1, 32) AS digest
            FROM requests r JOIN (SELECT request_id, action, errors = {checked}) c USING (request_id, action) WHERE valid)"""
    queries["T8_stream_open_orders_timers"] = queries["T8_stream_open_orders"]
    return queries
