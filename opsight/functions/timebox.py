"""Time windows relative to an explicit `as_of`, and tumbling or sliding buckets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def span(width: str | dt.timedelta) -> dt.timedelta:
    """`'90s'`, `'5m'`, `'1h'`, `'7d'` or a timedelta."""
    if isinstance(width, dt.timedelta):
        return width
    return dt.timedelta(**{_UNITS[width[-1]]: float(width[:-1])})


def moment(when: str | dt.datetime) -> dt.datetime:
    """A naive UTC datetime from ISO text or from a datetime (naive ones are taken as UTC)."""
    if isinstance(when, str):
        when = dt.datetime.fromisoformat(when)
    if when.tzinfo is not None:
        when = when.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return when


def start_of_day(as_of: str | dt.datetime) -> dt.datetime:
    return moment(as_of).replace(hour=0, minute=0, second=0, microsecond=0)


def instant(df: DataFrame, when: str | dt.datetime, column: str = "event_time") -> Column:
    """`when` as a literal of the column's own timestamp type, so comparisons reach the file scan uncast."""
    kind = df.schema[column].dataType.typeName()
    stamp = moment(when).isoformat(sep=" ")
    return F.lit(stamp if kind == "timestamp_ntz" else stamp + "+00:00").cast(kind)


def recent(
    df: DataFrame,
    as_of: str | dt.datetime,
    lookback: str | dt.timedelta | None = None,
    *,
    since: dt.datetime | None = None,
    strict: bool = False,
) -> DataFrame:
    """Rows from `as_of - lookback` (or from `since`) up to `as_of`.

    Tables stored by day also get the predicate on `event_date`, which prunes whole partitions.
    """
    end = moment(as_of)
    start = since if lookback is None else end - span(lookback)
    low, high = instant(df, start), instant(df, end)
    event_time = F.col("event_time")
    kept = (event_time > low if strict else event_time >= low) & (event_time <= high)
    if "event_date" in df.columns:
        kept = kept & F.col("event_date").between(F.lit(start.date()), F.lit(end.date()))
    return df.where(kept)


def until(df: DataFrame, as_of: str | dt.datetime | None, lookback: str | dt.timedelta | None = None) -> DataFrame:
    """Rows up to `as_of`, from `lookback` before it if given; without `as_of` all rows."""
    if as_of is None:
        return df
    if lookback is not None:
        return recent(df, as_of, lookback)
    kept = F.col("event_time") <= instant(df, as_of)
    if "event_date" in df.columns:
        kept = kept & (F.col("event_date") <= F.lit(moment(as_of).date()))
    return df.where(kept)


def utc_day(df: DataFrame, column: str = "event_time") -> Column:
    """The UTC day of a time, whatever the zone of the session."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.to_date(column)
    return F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(F.unix_micros(column) / 86_400_000_000).cast("int"))


def bucketed(
    df: DataFrame, width: str | dt.timedelta, keys: list[str], *aggs: Column, slide: str | dt.timedelta | None = None
) -> DataFrame:
    """Group by keys and epoch-aligned time bucket; the bucket start keeps the name `event_time`.

    Works on batch and streaming frames: grouping by the whole window keeps the watermark attached.
    """
    length = f"{int(span(width).total_seconds())} seconds"
    step = f"{int(span(slide).total_seconds())} seconds" if slide is not None else None
    grouped = df.groupBy(*keys, F.window("event_time", length, step).alias("bucket")).agg(*aggs)
    rest = [c for c in grouped.columns if c not in ("bucket", *keys)]
    return grouped.select(F.col("bucket.start").alias("event_time"), *keys, *rest)
