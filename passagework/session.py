"""Session settings of the engine; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "passagework", **more: str) -> SparkSession:
    """A session with adaptive execution and UTC; keyword settings use _ for the dot."""
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
