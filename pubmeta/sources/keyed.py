"""Tables laid out by the hash of a key, so that a small work list reads only the parts it needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from pubmeta.sources.workspace import new_folder, stored

BUCKET = "_bucket"
#: Keys of a work list that are also given to the scan by name, to skip row groups inside a part.
NAMED_KEYS = 1_000


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path`` in ``buckets`` partitions by the hash of ``key``."""

    spark: SparkSession
    path: str
    key: str
    buckets: int

    def table(self) -> DataFrame:
        """All rows, as they were written."""
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def rows_for(self, keys: DataFrame, column: str | None = None) -> DataFrame:
        """The rows whose key occurs in ``column`` of the work list.

        The work list is written first, so it is computed once. The driver sees the numbers of its buckets (at most
        ``buckets``), and its keys where they are at most NAMED_KEYS; the scan reads those partitions only. A semi join
        on the key decides. Where the list is too large to be broadcast, each bucket is joined with the keys of that
        bucket, which are as many times fewer as there are buckets: else the rows of the table, which may be wide, would
        be shuffled. Null keys match nothing.
        """
        wanted = keys.select(F.col(column or self.key).alias("_wanted")).where("_wanted IS NOT NULL").distinct()
        wanted = stored(wanted.withColumn(BUCKET, bucket_of(F.col("_wanted"), self.buckets)), "wanted")
        parts = [r[BUCKET] for r in wanted.select(BUCKET).distinct().collect()]
        rows = self.spark.read.parquet(self.path).where(F.col(BUCKET).isin(parts))
        named = [r["_wanted"] for r in wanted.limit(NAMED_KEYS + 1).collect()]
        if len(named) <= NAMED_KEYS:
            rows = rows.where(F.col(self.key).isin(named))
        elif len(parts) > 1 and _too_large_to_broadcast(wanted.drop(BUCKET)):
            path = new_folder(self.spark, "wanted-by-bucket")
            wanted.repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
            # read by its folder each, so that Spark knows the size of the keys of one bucket
            read = self.spark.read.schema(wanted.drop(BUCKET).schema)
            by_bucket = [
                self._matching(rows.where(F.col(BUCKET) == p), read.parquet(f"{path}/{BUCKET}={p}")) for p in sorted(parts)
            ]
            return reduce(DataFrame.unionByName, by_bucket)
        return self._matching(rows, wanted)

    def _matching(self, rows: DataFrame, wanted: DataFrame) -> DataFrame:
        rows, wanted = rows.drop(BUCKET), wanted.drop(BUCKET)
        return rows.join(wanted, rows[self.key] == wanted["_wanted"], "left_semi")

    def upsert(self, changes: DataFrame, *order: str) -> list[int]:
        """Replace or add rows by key (at most one change per key); only the buckets of changed keys are rewritten.

        Rows keep the columns that the table has. Returns the buckets written. The new content is written apart first
        and then moved in by overwriting those partitions, so a run that fails on the way can be repeated.
        """
        changes = stored(changes, "changes")
        number = bucket_of(F.col(self.key), self.buckets)
        parts = sorted(r["b"] for r in changes.where(F.col(self.key).isNotNull()).select(number.alias("b")).distinct().collect())
        if not parts:
            return parts
        old = self.spark.read.parquet(self.path).where(F.col(BUCKET).isin(parts)).drop(BUCKET)
        kept = old.join(changes.select(self.key), self.key, "left_anti")
        new = kept.unionByName(changes.where(F.col(self.key).isNotNull()).select(*[c for c in old.columns if c in changes.columns]), allowMissingColumns=True)
        content = stored(_placed(new, self.key, self.buckets, order), "buckets")
        _writer(content).option("partitionOverwriteMode", "dynamic").parquet(self.path)
        return parts


def _too_large_to_broadcast(df: DataFrame) -> bool:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size > df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def _placed(df: DataFrame, key: str, buckets: int, order: tuple[str, ...], sort: tuple[str, ...] = ()) -> DataFrame:
    columns = [BUCKET, key, *order]
    placed = df.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    # a stated number, as Spark would otherwise merge small parts at run time, and a key's rows into one file
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, *columns).sortWithinPartitions(*columns, *sort)


def _writer(df: DataFrame) -> DataFrameWriter:
    """Neighbouring rows are alike, above all documents: this codec makes them a third of what the default does."""
    written = df.write.mode("overwrite").partitionBy(BUCKET)
    return written.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6")


def write_keyed(
    df: DataFrame, path: str, key: str, buckets: int, *order: str, sort: tuple[str, ...] = (), dealt: bool = False
) -> KeyedTable:
    """Write rows as a ``KeyedTable``.

    Rows are range-partitioned by bucket, key and ``order``, so that a key with very many rows is many tasks and files,
    and sorted by them, so that row groups inside a file cover few keys. Rows that agree in all of these come to one
    file, where they are sorted by ``sort``.

    ``dealt`` says that the rows are spread over many tasks by now: each task sorts its own and writes them, a file for
    each bucket, and wide rows are not shuffled. Rows that bring their bucket (``BUCKET``) are sorted by it already.
    """
    if not dealt:
        placed = _placed(df, key, buckets, order, sort)
    elif BUCKET in df.columns:
        placed = df
    else:
        placed = df.withColumn(BUCKET, bucket_of(F.col(key), buckets)).sortWithinPartitions(BUCKET, key, *order, *sort)
    _writer(placed).parquet(path)
    return KeyedTable(df.sparkSession, path, key, buckets)


def whole_table(df: DataFrame, key: str) -> Callable[[DataFrame, str | None], DataFrame]:
    """The same lookup on a table without a layout: it is scanned whole for every work list."""
    return lambda keys, column=None: df.join(
        keys.select(F.col(column or key).alias("_wanted")), F.col(key) == F.col("_wanted"), "left_semi"
    )
