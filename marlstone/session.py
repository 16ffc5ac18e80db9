"""Spark sessions with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on (time zone) or that suit wide shuffles.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "marlstone", **conf: str) -> SparkSession:
    """A session with DEFAULTS; on a cluster leave master unset so that spark-submit decides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()
