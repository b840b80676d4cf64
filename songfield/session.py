"""A session with the settings the engine's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "songfield", master: str | None = None, **conf: object) -> SparkSession:
    """The active session, or a new one with adaptive execution and UTC time.

    Keyword settings use ``_`` for ``.``-free names only; give dotted names
    through ``conf={"spark.x.y": ...}`` by unpacking a dict.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k: str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
