"""Session settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tickloom", **settings: object) -> SparkSession:
    """A session in UTC, with ANSI errors and adaptive execution; ``settings`` with underscores for dots override."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), str(value))
    return builder.getOrCreate()
