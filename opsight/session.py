"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


_SETTINGS = {
    # event times, buckets and day starts are defined in UTC
    "spark.sql.session.timeZone": "UTC",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on; everything else is left to the cluster's configuration."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name that the driver and all executors can reach, below `spark.checkpoint.dir`.

    Where that is unset, a session that runs inside one JVM gets a temporary folder; on a cluster there is no folder
    that all machines share, so this raises. Whoever owns the checkpoint folder removes what is in it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=f"run-{label}-")
