"""Rules declared as data, evaluated as events arrive."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opsight.operators.loop import evaluate_range
from opsight.operators.routing import fan_out
from opsight.schemas import RAW
from opsight.sources.tables import read_table
from opsight.streaming.runner import each_batch, load_ids

_EPOCH = dt.datetime(1970, 1, 1)


def stream_rules(
    raw: DataFrame, root: str, checkpoint: str, rule_book: Callable[[], list[dict]], every: str | None = None
) -> StreamingQuery:
    """Route each micro-batch and evaluate all rules, windowed or not, on the time it covers.

    `rule_book` is asked before each micro-batch (`lambda: load_rules(path)` reads a file again), so a rule that is
    added while the stream runs counts from the next batch on. Event rules and windows see the stored events of the
    range, so a bucket that fills over several batches, or by late events, hits when it reaches its minimum. There is
    no state besides the stored hits, and a batch that runs again stores nothing twice: `reported_hits` equals the
    batch evaluation of the same events, except for events that came before their rule.
    """
    named = load_ids(raw.sparkSession, checkpoint)

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        spark, load = batch.sparkSession, named(batch_id)
        fan_out(batch, root, load)
        at = F.unix_micros(F.col("event_time").cast("timestamp"))
        first, last = read_table(spark, root, RAW, load).agg(F.min(at), F.max(at)).first()
        if first is not None:
            since, end = (_EPOCH + dt.timedelta(microseconds=m) for m in (first, last))
            evaluate_range(spark, root, rule_book(), since, end, f"rules-{load}", growing=True)

    return each_batch(raw, evaluate, checkpoint, every)
