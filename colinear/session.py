"""Session settings the library is written for; a cluster sets its own master and sizes."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "colinear", **more: str) -> SparkSession:
    """The active session, or a new one with ``CONF`` and ``more`` (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**CONF, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
