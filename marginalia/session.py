"""Session settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "marginalia", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; sizes are left to the cluster's own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k: str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
