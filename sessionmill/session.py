"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings that change results, not speed: instants are rendered and
# parsed in UTC, and a JSON line with a repeated key keeps the last value.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

SPEED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the result-relevant settings on a session somebody else built."""
    for key, value in RESULT_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, app: str = "sessionmill", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RESULT_CONF, **SPEED_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
