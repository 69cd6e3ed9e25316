"""Session settings that the library expects; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quillspark", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow. Shuffle partitions are left to the cluster: adaptive execution coalesces them."""
    b = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
