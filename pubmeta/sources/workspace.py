"""Where jobs keep checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_test_folders: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """Shared folder named by the session. Only a local test session may go without one."""
    configured = spark.conf.get(SETTING, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder every executor can reach")
    if context.applicationId not in _test_folders:
        _test_folders[context.applicationId] = tempfile.mkdtemp(prefix="pubmeta-")
    return _test_folders[context.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows as a table in the workspace: computed once, lineage cut, real sizes known."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a statement go when it ends, not when the driver next collects garbage.

    For jobs that write table after table. Streams started inside do likewise. A table that is read twice without
    being written is worked out again.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
