"""Outbox selection and status transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeta.schemas import FAILED, PUBLISHED

BATCH = 20


def pending_outbox(outbox: DataFrame, n: int = BATCH) -> DataFrame:
    """The ``n`` oldest messages not yet published; failed and stuck ones included."""
    return outbox.where(F.col("status") != PUBLISHED).orderBy("created_at", "id").limit(n)


def outbox_transition(outbox: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Rows after sending. ``results(id, error)`` has NULL ``error`` for a success; other rows stay."""
    sent = results.select("id", F.lit(True).alias("_sent"), F.col("error").alias("_error"))
    joined = outbox.join(sent, "id", "left")
    ok = F.coalesce(F.col("_sent"), F.lit(False)) & F.col("_error").isNull()
    bad = F.coalesce(F.col("_sent"), F.lit(False)) & F.col("_error").isNotNull()
    have = set(outbox.columns)

    def old(name: str, dtype: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(dtype)

    return joined.withColumns(
        {
            "status": F.when(ok, PUBLISHED).when(bad, FAILED).otherwise(F.col("status")),
            "retry_count": F.when(bad, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
            "last_error": F.when(ok, F.lit(None))
            .when(bad, F.col("_error"))
            .otherwise(old("last_error", "string")),
            "published_at": F.when(ok, now).otherwise(old("published_at", "timestamp")),
        }
    ).drop("_sent", "_error")
