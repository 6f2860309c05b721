"""Spark sessions with the settings that the language's semantics need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Errors instead of nulls on overflow and bad casts; UTC; plans that adapt to what they find.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, name: str = "layerloom", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def require(spark: SparkSession) -> None:
    """Raises if the session would change what the language means."""
    for key in ("spark.sql.ansi.enabled", "spark.sql.session.timeZone"):
        if spark.conf.get(key) != SETTINGS[key]:
            raise ValueError(f"the session needs {key}={SETTINGS[key]}")
