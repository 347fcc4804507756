"""Recommended session settings."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Skewed join keys are split at run time and small partitions merged.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM never compiles methods above 8,000 bytes; larger fused stages would run interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Wall-clock columns are zone free; the zone only matters for display.
    "spark.sql.session.timeZone": "UTC",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings to a session builder.

    On a cluster also set ``spark.checkpoint.dir`` to a folder that all executors share.
    """
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
