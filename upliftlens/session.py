"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Executor counts, memory and shuffle width belong to the cluster and are not set here.
SETTINGS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits the partition of a user who owns a large share of all sessions.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hashes instead of sorting where run-time sizes show that every partition of a side is small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # Building a plan is a third of a small query's time, much of it call-site capture per column.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app: str, master: str | None = None, extra: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
