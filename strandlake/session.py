"""A session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # of a header's repeated tags the last one counts
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(name: str = "strandlake", **extra: str) -> SparkSession:
    """The running session, or a new one, with SETTINGS; ``extra`` uses __ for dots."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
