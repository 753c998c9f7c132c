"""Session defaults shared by the entry points, the tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every session of this library wants; a cluster's own values for other keys are left alone.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; `conf` overrides them (underscores stand for dots)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
