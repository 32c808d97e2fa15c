"""Stored event tables: parquet by day and load, published by a manifest.

Layout: `<root>/<table>/event_date=<day>/batch_id=<load>.<stamp>/`. Time filters prune days. A load counts once its
record is published (see `manifest`); writing it again replaces what it wrote before, so a retried load or micro-batch
neither loses nor doubles rows. The change log of order states is stored by hash of the order instead of by day.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.functions import as_int, as_long, latest_by, span, utc_day
from opsight.functions.timebox import moment
from opsight.schemas import EVENT_TABLES, ORDER_STATES, QUARANTINE, STATIONS, TABLE_SCHEMAS
from opsight.sources import manifest

BUCKETS = 8  # of order states; fixed for the life of a root
MERGED_BYTES = 128 << 20
MERGE_FAN = 8
LOADED_AS = "_load"  # in merged files: the load and stamp a row came with
_CELLS = {
    ORDER_STATES: T.StructField("bucket", T.IntegerType()),
    QUARANTINE: T.StructField("reason", T.StringType()),
}


def _cell(name: str) -> T.StructField:
    """The partition column of a table."""
    return _CELLS.get(name, T.StructField("event_date", T.DateType()))


def order_bucket() -> Column:
    return F.pmod(F.xxhash64("order_id"), F.lit(BUCKETS)).cast("int")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of `schema`: missing ones null, extra ones dropped, values converted where possible."""

    def fitted(field: T.StructField) -> Column:
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        have, value = df.schema[field.name].dataType, F.col(field.name)
        if have == field.dataType:
            return value
        if isinstance(field.dataType, T.StringType) and isinstance(have, (T.StructType, T.MapType, T.ArrayType)):
            value = F.to_json(value)
        elif isinstance(field.dataType, T.LongType) and isinstance(have, T.StringType):
            value = as_long(value)
        elif isinstance(field.dataType, T.IntegerType) and isinstance(have, T.StringType):
            value = as_int(value)
        else:
            value = value.try_cast(field.dataType)
        return value.alias(field.name)

    return df.select(*[fitted(f) for f in schema.fields])


def write_table(df: DataFrame, root: str, name: str, batch_id: str | int, *, rebalance: bool = True) -> None:
    """Write and publish one load of one table."""
    stamp = manifest.new_stamp()
    cells = write_files(df, root, name, batch_id, stamp, rebalance=rebalance)
    manifest.publish_load(df.sparkSession, root, str(batch_id), stamp, {name: cells})


def write_files(
    df: DataFrame, root: str, name: str, batch_id: str | int, stamp: int, *, rebalance: bool = True
) -> dict[str, list[int]]:
    """Write one load of one table without publishing it: files and bytes by cell.

    Rebalancing by day lets adaptive execution cut big days into several files and merge small ones, instead of every
    task writing one file per day. Rows are sorted by time inside a file, which keeps row-group statistics narrow.
    """
    if not re.fullmatch(r"[\w.\-]+", str(batch_id)):
        raise ValueError(f"load {batch_id!r}: letters, digits, '.', '_' and '-' only")
    cell, folder = _cell(name).name, f"{batch_id}.{stamp}"
    schema = TABLE_SCHEMAS[name]
    if name == QUARANTINE:
        schema, place = T.StructType([*schema.fields, _cell(name)]), F.col(cell)
    rows = conform(df, schema)
    if name != QUARANTINE:
        place = order_bucket() if name == ORDER_STATES else utc_day(rows)
    rows = rows.withColumns({cell: place, "batch_id": F.lit(folder)})
    if rebalance:
        rows = rows.hint("rebalance", cell)
    order = [cell, "batch_id", *[c for c in ("event_time",) if c in rows.columns]]
    rows.sortWithinPartitions(*order).write.mode("append").partitionBy(cell, "batch_id").parquet(f"{root}/{name}")
    return _written(df.sparkSession, root, name, folder)


def _written(spark: SparkSession, root: str, name: str, folder: str) -> dict[str, list[int]]:
    found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for path, size in manifest.Files(spark, root).matching(f"{root}/{name}/{_cell(name).name}=*/batch_id={folder}/*.parquet"):
        files = found[path.rsplit("/", 3)[1].partition("=")[2]]
        files[0] += 1
        files[1] += size
    return dict(found)


def _scan(spark: SparkSession, root: str, name: str, parts: list[manifest.Part]) -> DataFrame:
    """Rows of the given folders with their cell, `batch_id` and `_load`."""
    cell = _cell(name)
    fields = [T.StructField(LOADED_AS, T.StringType()), cell, T.StructField("batch_id", T.StringType())]
    layout = T.StructType([*TABLE_SCHEMAS[name].fields, *fields])
    if not parts:
        return spark.createDataFrame([], layout)
    paths = [f"{root}/{name}/{cell.name}={p.cell}/batch_id={p.name}" for p in parts]
    return spark.read.schema(layout).option("basePath", f"{root}/{name}").parquet(*paths)


def read_files(spark: SparkSession, root: str, name: str, batch_id: str | int, stamp: int, cells: dict) -> DataFrame:
    """A load that was written but is not published yet."""
    parts = [manifest.Part(c, f"{batch_id}.{stamp}", 0, *size, ()) for c, size in cells.items()]
    return _scan(spark, root, name, parts).drop("batch_id", LOADED_AS)


def read_table(
    spark: SparkSession, root: str, name: str, batch_id: str | int | None = None, state: manifest.State | None = None
) -> DataFrame:
    """A stored table, or one load of it, with its `event_date`, which `recent` uses to prune days.

    Tables read with one `state` show the same loads.
    """
    state = state or manifest.state(spark, root)
    if batch_id is not None:
        parts, folder = state.load_parts(name, str(batch_id))
        rows = _scan(spark, root, name, parts)
        return rows.where(F.coalesce(F.col(LOADED_AS), F.col("batch_id")) == F.lit(folder)).drop("batch_id", LOADED_AS)
    parts, masked = state.parts(name)
    rows = _scan(spark, root, name, parts)
    if masked:
        rows = rows.where(F.col(LOADED_AS).isNull() | ~F.col(LOADED_AS).isin(masked))
    return rows.drop("batch_id", LOADED_AS)


def clear_tables(spark: SparkSession, root: str, dry_run: bool = False) -> list[str]:
    """Empty the seven event tables and keep `stations`; with `dry_run` only name them."""
    if not dry_run:
        manifest.publish(spark, root, {"kind": "clear", "stamp": manifest.new_stamp(), "tables": list(EVENT_TABLES)})
        manifest.vacuum(spark, root, EVENT_TABLES, dt.timedelta(0))
    return [f"{root}/{name}" for name in EVENT_TABLES]


# --- merging ---------------------------------------------------------------------------------------------------------


def packed_bins(parts: list[manifest.Part], target: int) -> list[list[manifest.Part]]:
    """First-fit-decreasing: parts below half the target share bins of about the target; lone parts of one file stay."""
    bins: list[tuple[int, list[manifest.Part]]] = []
    for part in sorted((p for p in parts if p.size < target // 2 or p.files > 1 + p.size // target), key=lambda p: (-p.size, p.name)):
        for at, (size, held) in enumerate(bins):
            if size + part.size <= target:
                bins[at] = (size + part.size, [*held, part])
                break
        else:
            bins.append((part.size, [part]))
    return [held for _, held in bins if len(held) > 1 or held[0].files > 1]


def full_levels(parts: list[manifest.Part], fan: int) -> list[list[manifest.Part]]:
    """Runs of one level, once there are `fan` of them: merged they make one run of the next level."""
    levels: dict[int, list[manifest.Part]] = defaultdict(list)
    for part in parts:
        levels[part.level].append(part)
    return [held for held in levels.values() if len(held) >= fan]


def _merge(
    spark: SparkSession,
    root: str,
    name: str,
    choose: Callable[[list[manifest.Part]], list[list[manifest.Part]]],
    reduced: Callable[[DataFrame], DataFrame],
    taken: Callable[[str], bool],
) -> int:
    """Replace the chosen groups of parts of each cell by one generation each; returns how many were made.

    One job for all groups: each goes to a task of its own, so a group becomes one file. Its size is bounded by what
    `choose` puts together.
    """
    parts, masked = manifest.state(spark, root).parts(name)
    cells: dict[str, list[manifest.Part]] = defaultdict(list)
    for part in parts:
        if taken(part.cell):
            cells[part.cell].append(part)
    groups = [(cell, group) for cell, held in cells.items() for group in choose(held)]
    if not groups:
        return 0
    stamp, cell = manifest.new_stamp(), _cell(name).name
    names = [f"merged-{uuid.uuid4().hex[:12]}.{stamp}" for _ in groups]
    plan = [(c, part.name, made) for made, (c, group) in zip(names, groups) for part in group]
    moves = spark.createDataFrame(plan, "place string, batch_id string, made string")
    rows = _scan(spark, root, name, [part for _, group in groups for part in group])
    if masked:
        rows = rows.where(F.col(LOADED_AS).isNull() | ~F.col(LOADED_AS).isin(masked))
    rows = rows.withColumn(LOADED_AS, F.coalesce(LOADED_AS, "batch_id")).withColumn("place", F.coalesce(F.col(cell).cast("string"), F.lit(manifest.NULL_CELL)))
    rows = rows.join(moves, ["place", "batch_id"]).drop("place", "batch_id")  # a row for each folder merged
    rows = reduced(rows.withColumnRenamed("made", "batch_id")).repartition(cell, "batch_id")
    rows.sortWithinPartitions(cell, "batch_id", "event_time").write.mode("append").partitionBy(cell, "batch_id").parquet(f"{root}/{name}")
    generations = []
    for made, (place, group) in zip(names, groups):
        files, size = _written(spark, root, name, made).get(place, [0, 0])
        covers = sorted({pair for part in group for pair in part.covers})
        replaces = [part.name for part in group if part.level]
        level = 1 + max(part.level for part in group)
        generations.append({"name": made, "cell": place, "level": level, "files": files, "size": size, "covers": covers, "replaces": replaces})
    manifest.publish(spark, root, {"kind": "merge", "stamp": stamp, "table": name, "generations": generations})
    return len(groups)


def merge_days(
    spark: SparkSession, root: str, before: str | dt.datetime, tables: tuple[str, ...] = EVENT_TABLES, target: int = MERGED_BYTES
) -> int:
    """Pack the small files of closed days (those that end before `before`) into files of about `target` bytes.

    Readers see every row once all the time; replaced folders go with `manifest.vacuum`. Late loads of a closed day are
    packed by the next call. The records of merged loads are folded into one.
    """
    open_from = moment(before).date().isoformat()
    made = sum(
        _merge(spark, root, name, lambda held: packed_bins(held, target), lambda rows: rows, lambda day: day < open_from)
        for name in tables
    )
    if made:
        manifest.checkpoint(spark, root)
    return made


def merge_order_states(spark: SparkSession, root: str, fan: int = MERGE_FAN) -> int:
    """Merge the change log of order states level by level, keeping the newest event of each order.

    A run of a level is made of `fan` runs of the level below, so a bucket of n micro-batches has at most `fan` runs on
    each of log(n) levels, and each row is rewritten once a level.
    """
    made = 0
    while more := _merge(
        spark, root, ORDER_STATES, lambda held: full_levels(held, fan), lambda rows: latest_by(rows, "batch_id", "order_id"), lambda bucket: True
    ):
        made += more
    if made:
        manifest.checkpoint(spark, root)
    return made


def retain(df: DataFrame, as_of: str | dt.datetime, days: int = 30) -> DataFrame:
    """Rows of the last `days` whole days before `as_of` and later; a filter on days alone."""
    oldest = (moment(as_of) - span(f"{days}d")).date()
    day = F.col("event_date") if "event_date" in df.columns else utc_day(df)
    return df.where(day >= F.lit(oldest))


def expire(spark: SparkSession, root: str, as_of: str | dt.datetime, days: int = 30) -> list[str]:
    """Drop stored days older than `retain` keeps. Only folders are removed; no data file is read or rewritten."""
    oldest = (moment(as_of) - span(f"{days}d")).date()
    record = {"kind": "expire", "stamp": manifest.new_stamp(), "tables": list(EVENT_TABLES), "before": oldest.isoformat()}
    manifest.publish(spark, root, record)
    files, dropped = manifest.Files(spark, root), []
    for name in EVENT_TABLES:
        for path, _ in files.matching(f"{root}/{name}/event_date=*"):
            day = path.rsplit("/", 1)[1].partition("=")[2]
            if day[:4].isdigit() and dt.date.fromisoformat(day) < oldest:
                files.delete(path)
                dropped.append(f"{name}/{day}")
    return dropped


def stored_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows per stored event table, plus the station reference."""
    state = manifest.state(spark, root)
    counts = [
        read_table(spark, root, name, state=state).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name in EVENT_TABLES
    ]
    reference = spark.read.parquet(f"{root}/{STATIONS}").agg(F.count("*").alias("rows"))
    counts.append(reference.select(F.lit(STATIONS).alias("table_name"), "rows"))
    total = counts[0]
    for part in counts[1:]:
        total = total.unionByName(part)
    return total
