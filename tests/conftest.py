import datetime as dt
import json
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from opsight.schemas import RAW, TABLE_SCHEMAS  # noqa: E402

NOON = dt.datetime(2024, 1, 1, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("opsight-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-test-")


def event(name, at, *, n=[0], order="", station="", ingredient="", channel="", severity="info", payload=None, id=None):
    """One raw event as a tuple; `at` is seconds after noon or a datetime; payload a dict or raw text."""
    n[0] += 1
    when = at if isinstance(at, dt.datetime) else NOON + dt.timedelta(seconds=at)
    when = when.replace(tzinfo=dt.timezone.utc)
    body = payload if payload is None or isinstance(payload, str) else json.dumps(payload, separators=(",", ":"))
    return (when, id or f"e{n[0]:06d}", name, "", "", order, station, ingredient, channel, severity, body)


@pytest.fixture
def raw(spark):
    def build(*events):
        return spark.createDataFrame(list(events), TABLE_SCHEMAS[RAW])

    return build


def rows(df, *columns):
    """Rows as sorted tuples of the given (or all) columns."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
