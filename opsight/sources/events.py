"""JSON events into the landing layout, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.schemas import RAW, RAW_COLUMNS, TABLE_SCHEMAS

CORRUPT = "_corrupt_record"
_JSON_LAYOUT = T.StructType([*TABLE_SCHEMAS[RAW].fields, T.StructField(CORRUPT, T.StringType())])
_JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def _fits() -> Column:
    """A whole JSON object with a readable time; testing the time keeps it parsed when later columns are pruned."""
    return F.col(CORRUPT).isNull() & F.col("event_time").isNotNull()


def _landed(parsed: DataFrame) -> DataFrame:
    return parsed.where(_fits()).select(*RAW_COLUMNS)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """One JSON event per line (UTF-8); the nested payload stays JSON text. Lines that do not fit are left out."""
    return _landed(spark.read.schema(_JSON_LAYOUT).options(**_JSON_OPTIONS).json(path))


def read_malformed(spark: SparkSession, path: str) -> DataFrame:
    """The lines `read_raw` leaves out, with their file."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", _JSON_LAYOUT, _JSON_OPTIONS)
    return (
        lines.select(F.input_file_name().alias("file"), F.col("value").alias("line"), parsed.alias("event"))
        .select("file", "line", "event.*")
        .where(~_fits())
        .select("file", "line")
    )


def stream_raw(
    spark: SparkSession, path: str | None = None, *, source: str = "json", options: dict[str, str] | None = None
) -> DataFrame:
    """Continuous ingest into the landing layout.

    `source='json'` watches a folder of JSON-lines files. Any other source (for example `kafka`) must deliver the JSON
    text in `value`; its connection settings go into `options`.
    """
    reader = spark.readStream.options(**(options or {}))
    if source == "json":
        return _landed(reader.schema(_JSON_LAYOUT).options(**_JSON_OPTIONS).json(path))
    lines = reader.format(source).load() if path is None else reader.format(source).load(path)
    parsed = F.from_json(F.col("value").cast("string"), _JSON_LAYOUT, _JSON_OPTIONS)
    return _landed(lines.select(parsed.alias("event")).select("event.*"))


def stream_parsed(spark: SparkSession, path: str, *, options: dict[str, str] | None = None) -> DataFrame:
    """JSON-lines files as a stream of everything they hold, readable or not, for `landed_and_rejected`."""
    reader = spark.readStream.options(**(options or {})).schema(_JSON_LAYOUT).options(**_JSON_OPTIONS)
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("file"))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """The same for a frame or stream with the JSON text in `value`, as message queues deliver it."""
    text = F.col("value").cast("string")
    parsed = lines.select(F.from_json(text, _JSON_LAYOUT, _JSON_OPTIONS).alias("event")).select("event.*")
    return parsed.withColumn("file", F.lit(None).cast("string"))


def landed_and_rejected(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The raw events of parsed input, and what does not fit: file, line, reason.

    `unreadable`: no JSON object, or a value that is not of its type, with the line as it came. `no_time`: an event
    without a time; its line is written anew from its columns.
    """
    again = F.to_json(F.struct(*[c for c in RAW_COLUMNS if c != "event_time"]))
    reason = F.when(F.col(CORRUPT).isNotNull(), "unreadable").otherwise("no_time")
    rejected = parsed.where(~_fits()).select("file", F.coalesce(F.col(CORRUPT), again).alias("line"), reason.alias("reason"))
    return _landed(parsed), rejected


def write_json(raw: DataFrame, path: str, mode: str = "append") -> None:
    """Raw events as JSON lines with the payload nested as it is, ready for `read_raw` and `stream_raw`."""
    envelope = [c for c in RAW_COLUMNS if c not in ("event_time", "payload")]
    stamp = F.date_format(F.col("event_time").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    head = F.to_json(F.struct(stamp.alias("event_time"), *envelope))
    opened = F.substring(head, F.lit(1), F.length(head) - 1)
    payload = F.coalesce("payload", F.lit("null"))
    line = F.concat(opened, F.lit(',"payload":'), payload, F.lit("}"))
    raw.select(line.alias("value")).write.mode(mode).text(path)
