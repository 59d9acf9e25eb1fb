"""A session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive plans with skew joins; the cluster's own settings win."""
    builder = SparkSession.builder.appName("engram")
    if master:
        builder = builder.master(master)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | settings
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
