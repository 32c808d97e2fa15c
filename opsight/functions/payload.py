"""Schema-on-read access to the JSON payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload_fields(*names: str, source: str = "payload") -> list[Column]:
    """Payload keys as text columns, in the given order; convert them with `as_double` / `as_long`.

    One key uses `get_json_object`, which stays inside generated code. Several keys share one parse: naming the mode
    keeps the optimizer from splitting the parse into one per key.
    """
    if len(names) == 1:
        return [F.get_json_object(F.col(source), f"$.{names[0]}")]
    layout = ", ".join(f"`{n}` string" for n in names)
    parsed = F.from_json(F.col(source), layout, {"mode": "PERMISSIVE"})
    return [parsed.getField(n) for n in names]
