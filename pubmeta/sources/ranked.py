"""Tables laid out by key ranges with their row counts, so that any page of the order is one short read."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubmeta.sources.workspace import stored

RANGE = "_range"
#: Rows of a range; a page reads the ranges that it touches. There are at most MOST_RANGES, which then grow.
ROWS_PER_RANGE = 100_000
MOST_RANGES = 4096


@dataclass
class RankedTable:
    """Rows at ``path/rows`` in one partition per key range, and ``path/index`` with the ranges and their row counts.

    A range holds the keys from its ``low`` up to the next one's. The first range also holds all lower keys. Rows
    without a key are not part of the order. The index has a row per range, at most MOST_RANGES, and is what the driver reads.
    """

    spark: SparkSession
    path: str
    key: str
    rows_per_range: int = ROWS_PER_RANGE

    def ranges(self) -> list[tuple]:
        """``(range, low, rows)`` in key order."""
        rows = self.spark.read.parquet(f"{self.path}/index").orderBy("low").collect()
        return [(r["range"], r["low"], r["rows"]) for r in rows]

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop(RANGE)

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 0) in key order; negative numbers and sizes are clamped.

        The counts before each range say which ranges hold the page; only their partitions are read and ordered.
        """
        take = max(1, size)
        start = max(0, number) * take
        ranges = self.ranges()
        before = [0, *accumulate(r[2] for r in ranges)]
        first = max(bisect_right(before, start) - 1, 0)
        wanted = [r[0] for k, r in enumerate(ranges) if k >= first and before[k] < start + take]
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col(RANGE).isin(wanted)).drop(RANGE)
        return rows.orderBy(self.key).offset(start - before[first]).limit(take) if wanted else rows.limit(0)

    def _number(self, ranges: list[tuple]) -> Column:
        """The range of a key: as many lower ends as it has reached, found by halving."""
        if len(ranges) == 1:
            return F.lit(ranges[0][0])
        lows = F.array(*[F.lit(low) for _, low, _ in ranges[1:]])
        numbers = F.split(F.lit(",".join(str(r) for r, _, _ in ranges)), ",").cast("array<int>")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range((len(ranges) - 1).bit_length()))])

        def reach(at: Column, step: Column) -> Column:
            return at + F.when(F.get(lows, at + step - 1) <= F.col(self.key), step).otherwise(0)

        return F.get(numbers, F.aggregate(steps, F.lit(0), reach))

    def upsert(self, changes: DataFrame) -> list[int]:
        """Replace or add rows by key (at most one change per key); returns the ranges rewritten and counted again.

        Ranges without changed keys are neither read nor written. A range that has grown to twice ``rows_per_range`` is
        split. Content is written apart first, then moved in, and the index comes last.
        """
        changes = stored(changes.where(F.col(self.key).isNotNull()), "ranked-changes")
        ranges = self.ranges()
        if not ranges:
            write_ranked(changes, self.path, self.key, self.rows_per_range)
            return [r[0] for r in self.ranges()]
        changes = stored(changes.withColumn(RANGE, self._number(ranges)), "ranked-changes")
        touched = sorted(r[RANGE] for r in changes.select(RANGE).distinct().collect())
        if not touched:
            return touched
        # rows that stay are in their range already
        old = self.spark.read.parquet(f"{self.path}/rows").where(F.col(RANGE).isin(touched))
        kept = old.join(changes.select(self.key), self.key, "left_anti")
        new = stored(kept.unionByName(changes, allowMissingColumns=True).select(*old.columns), "ranked-rows")
        counts = {r[RANGE]: r["n"] for r in new.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).collect()}
        lows = {r: low for r, low, _ in ranges}
        result = {r: (low, n) for r, low, n in ranges if r not in touched}
        fresh = max(lows) + 1
        for r in touched:
            n = counts.get(r, 0)
            result[r] = (lows[r], n)
            # ranges still to come count as well: at MOST_RANGES none is split
            parts = min(n // self.rows_per_range, 1 + MOST_RANGES - len(ranges) - (fresh - max(lows) - 1))
            if parts < 2:
                continue
            shares = [k / parts for k in range(1, parts)]
            mine = new.where(F.col(RANGE) == r)
            cuts = mine.agg(F.percentile_approx(self.key, shares, 10_000).alias("c")).first()["c"]
            number = F.lit(r)
            for low in sorted(set(cuts) - {lows[r]}):
                number = F.when(F.col(self.key) >= F.lit(low), F.lit(fresh)).otherwise(number)
                result[fresh] = (low, 0)
                fresh += 1
            split = mine.withColumn(RANGE, number)
            new = stored(new.where(F.col(RANGE) != r).unionByName(split), "ranked-split")
        if fresh > max(lows) + 1:
            counted = new.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).collect()
            for r in counted:
                result[r[RANGE]] = (result[r[RANGE]][0], r["n"])
        # a stated number, else small rows are merged into one task that writes the files of all ranges
        tasks = min(len(result), 3 * self.spark.sparkContext.defaultParallelism)
        writer = new.repartition(tasks, RANGE).sortWithinPartitions(RANGE, self.key).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(f"{self.path}/rows")
        _write_index(self.spark, self.path, new.schema[self.key], [(r, low, n) for r, (low, n) in result.items()])
        return touched


def _write_index(spark: SparkSession, path: str, key, ranges: list[tuple]) -> None:
    ddl = f"range INT, low {key.dataType.simpleString()}, rows BIGINT"
    spark.createDataFrame(ranges, ddl).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def write_ranked(df: DataFrame, path: str, key: str, rows_per_range: int = ROWS_PER_RANGE) -> RankedTable:
    """Write rows as a ``RankedTable``. One range partitioning lays them out and cuts the ranges."""
    spark = df.sparkSession
    rows = stored(df.where(F.col(key).isNotNull()), "ranked-input")
    parts = min(MOST_RANGES, max(1, -(-rows.count() // rows_per_range)))
    dealt = rows.repartitionByRange(parts, key).withColumn(RANGE, F.spark_partition_id())
    dealt.sortWithinPartitions(key).write.mode("overwrite").partitionBy(RANGE).parquet(f"{path}/rows")
    found = spark.read.schema(dealt.schema).parquet(f"{path}/rows").groupBy(RANGE)
    found = found.agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("n")).collect()
    _write_index(spark, path, df.schema[key], [(r[RANGE], r["low"], r["n"]) for r in found])
    return RankedTable(spark, path, key, rows_per_range)
