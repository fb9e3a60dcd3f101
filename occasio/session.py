"""The session that the engine's jobs run in."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the operators are written for; other settings are the cluster's.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "occasio", **settings: str) -> SparkSession:
    """The running session, or a new one; keyword names have _ for the dots of Spark's names after "spark."."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    for name, value in settings.items():
        builder = builder.config(f"spark.{name.replace('_', '.')}", value)
    return builder.getOrCreate()


def close() -> None:
    """Stop the running session, if there is one."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.stop()
