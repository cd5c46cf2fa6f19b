"""Session settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results or plans rely on; a cluster's own sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "millrace", **more: str) -> SparkSession:
    """A session with the engine's settings; keyword settings use '__' for '.'."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()
