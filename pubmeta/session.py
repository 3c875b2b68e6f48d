"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Run-time choices: broadcast below the size threshold, split skewed join partitions, merge small ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # XML documents are large: bound Arrow batches by bytes, not only by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    # Call-site capture on every column expression slows plan building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(app_name: str = "pubmeta") -> SparkSession.Builder:
    """Builder with these settings; the caller adds master, memory and ``spark.checkpoint.dir``."""
    b = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b
