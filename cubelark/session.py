"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: A side of at most this many bytes is broadcast by the automatic join; settable per session.
BROADCAST_BYTES = 16 << 20


def session(name: str = "cubelark", **conf: str) -> SparkSession:
    """A session with adaptive execution, a 16 MiB broadcast limit and UTC."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(BROADCAST_BYTES),
        "spark.sql.session.timeZone": "UTC",
    }
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()
