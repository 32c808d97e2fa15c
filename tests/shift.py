"""A short evening shift as literal rows: six orders, one of which stays open."""

from conftest import event

# second, event, order, station, ingredient, channel, payload
ROWS = [
    (0, "kitchen.station.updated", "", "grill", "", "", {"station_status": "normal", "queue_size": 4, "capacity": 6}),
    (1, "order.created", "A1", "grill", "", "delivery", {"order_status": "created"}),
    (2, "kitchen.station.updated", "", "fryer", "", "", {"station_status": "saturated", "queue_size": 9, "capacity": 6}),
    (3, "order.created", "A2", "fryer", "", "dine-in", {"order_status": "created"}),
    (4, "inventory.level.changed", "", "", "beef", "", {"stock_pct": 40, "threshold_pct": 15}),
    (5, "order.prep.delayed", "A2", "fryer", "", "dine-in", {"order_status": "in_prep", "delay_minutes": 6, "queue_size": 9}),
    (6, "payment.completed", "A1", "grill", "", "delivery", {"order_status": "completed"}),
    (7, "order.created", "A3", "fryer", "", "delivery", {"order_status": "created"}),
    (8, "order.prep.delayed", "A3", "fryer", "", "delivery", {"order_status": "in_prep", "delay_minutes": 7.5, "queue_size": 8}),
    (9, "inventory.level.changed", "", "", "fries", "", {"stock_pct": 5, "threshold_pct": 15}),
    (10, "customer.sentiment.signal", "A3", "", "", "delivery", {"sentiment": "negative", "reason": "cold"}),
    (11, "payment.completed", "A2", "fryer", "", "dine-in", {"order_status": "completed"}),
    (12, "order.created", "A4", "sauces", "", "takeout", {"order_status": "created"}),
    (13, "order.prep.delayed", "A4", "sauces", "", "takeout", {"order_status": "in_prep", "delay_minutes": 3, "queue_size": 2}),
    (14, "payment.completed", "A3", "fryer", "", "delivery", {"order_status": "completed"}),
    (15, "kitchen.station.updated", "", "fryer", "", "", {"station_status": "normal", "queue_size": 5, "capacity": 6}),
    (16, "order.created", "A5", "assembly", "", "delivery", {"order_status": "created"}),
    (17, "order.prep.delayed", "A5", "assembly", "", "delivery", {"order_status": "in_prep", "delay_minutes": 12, "queue_size": 7}),
    (18, "customer.sentiment.signal", "A5", "", "", "delivery", {"sentiment": "negative", "reason": "late"}),
    (19, "payment.completed", "A4", "sauces", "", "takeout", {"order_status": "completed"}),
    (20, "order.created", "A6", "grill", "", "delivery", {"order_status": "created"}),
    (21, "order.prep.delayed", "A6", "grill", "", "delivery", {"order_status": "in_prep", "delay_minutes": 5, "queue_size": 6}),
    (22, "inventory.level.changed", "", "", "fries", "", {"stock_pct": 30, "threshold_pct": 15}),
    (23, "payment.completed", "A5", "assembly", "", "delivery", {"order_status": "completed"}),
]


def evening_shift():
    return [
        event(name, at, order=order, station=station, ingredient=ingredient, channel=channel, payload=payload)
        for at, name, order, station, ingredient, channel, payload in ROWS
    ]
