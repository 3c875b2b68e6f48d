"""Resharding by minimum-cost flow: which blocks of bytes move between shards, and the files that change."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pubmeta.llm.common import Scratch, free_names


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Amounts from each source to each sink at least cost; the capacities must hold the supply.

    Successive shortest paths: while a source has something left, the cheapest path from it to a sink with room is
    found in the residual network (Bellman-Ford, as going back over a transfer has a negative cost) and filled.
    The network has one node per old and per new shard, so its size has nothing to do with that of the data.
    """
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    for start in range(n):
        while left[start]:
            dist = [math.inf] * (n + m)
            came = [-1] * (n + m)
            dist[start] = 0
            for _ in range(n + m):
                changed = False
                for i in range(n):
                    for j in range(m):
                        if dist[i] + cost[i][j] < dist[n + j]:
                            dist[n + j], came[n + j], changed = dist[i] + cost[i][j], i, True
                        if flow[i][j] and dist[n + j] - cost[i][j] < dist[i]:
                            dist[i], came[i], changed = dist[n + j] - cost[i][j], n + j, True
                if not changed:
                    break
            end = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j])
            path = [n + end]
            while path[-1] != start:
                path.append(came[path[-1]])
            steps = list(zip(path[1:], path[:-1], strict=True))
            most = min([left[start], room[end], *(flow[b][a - n] for a, b in steps if a >= n)])
            for a, b in steps:
                if a < n:
                    flow[a][b - n] += most
                else:
                    flow[b][a - n] -= most
            left[start] -= most
            room[end] -= most
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def transfers(old_sizes: list[int], capacity: list[int]) -> list[list[int]]:
    """Bytes from each old shard to each new one; a byte that stays costs nothing, one that moves costs one."""
    cost = [[int(i != j) for j in range(len(capacity))] for i in range(len(old_sizes))]
    return min_cost_flow(old_sizes, capacity, cost)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with the bytes of their old shard that come before them in it."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for batch in batches:
        shard, size = batch.column("old_shard").to_numpy(), batch.column("size").to_numpy()
        before = np.empty(len(size), np.int64)
        for s in np.unique(shard):
            at = shard == s
            ends = np.cumsum(size[at])
            before[at] = seen.get(int(s), 0) + ends - size[at]
            seen[int(s)] = seen.get(int(s), 0) + int(ends[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(before)],
            names=[*batch.schema.names, "part", "before"],
        )


def _assigned(starts: dict[tuple[int, int], int], edges: dict[int, tuple[np.ndarray, np.ndarray]]):
    """The new shard of each row: where the middle of its bytes falls in its old shard's transfers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, size = batch.column("old_shard").to_numpy(), batch.column("size").to_numpy()
            part, before = batch.column("part").to_numpy(), batch.column("before").to_numpy()
            new = np.empty(len(size), np.int32)
            for s in np.unique(shard):
                for p in np.unique(part[shard == s]):
                    at = np.flatnonzero((shard == s) & (part == p))
                    middle = starts[int(p), int(s)] + before[at] + size[at] / 2
                    ends, to = edges[int(s)]
                    new[at] = to[np.minimum(np.searchsorted(ends, middle, "right"), len(to) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("old_shard"), pa.array(new)], names=["id", "old_shard", "shard"]
            )

    return run


def resharded(docs: DataFrame, old_shard: Column, shards: int = 8, capacity: list[int] | None = None) -> DataFrame:
    """Move as few bytes as the new capacities allow.

    Takes ``doc_id long, text`` and an expression for the shard that holds each row now (0 to shards - 1; null is 0)
    and returns ``doc_id, size, text_crc32, old_shard, shard, slot, row``, one row per input row; ``row`` holds all columns
    of the input. A document's size is its
    bytes in UTF-8 plus one; a null text has none. ``capacity`` defaults to equal parts and must hold the total.
    Null and repeated doc_ids are rows like any other. An empty table gives an empty result.

    The flow says how many bytes each shard keeps and sends where. Each shard's rows are range-sorted, large ones
    first, which stay, so that the borders between transfers fall among small rows; a row goes where the middle of
    its bytes falls, and a shard misses its capacity by less than a row at each border. The sort splits a shard that holds
    most rows over many partitions; the driver holds numbers per shard and partition only.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *_digest(F.col("text")),
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"),
        F.rand(11).alias("tie"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )
    order = ["old_shard", F.desc("size"), "tie"]
    # the texts stay out of Python, as the largest are next to each other; the number of a row is fixed by being written
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    sorted_ = scratch.table(sorted_.withColumn("id", F.monotonically_increasing_id()), "sorted")
    light = sorted_.select("id", "old_shard", "size").repartitionByRange("id").sortWithinPartitions("id")
    running = scratch.table(light.mapInArrow(_running, "id long, old_shard int, size long, part int, before long"), "running")
    starts: dict[tuple[int, int], int] = {}
    old = [0] * shards
    for r in running.groupBy("part", "old_shard").agg(F.sum("size").alias("size")).orderBy("part").collect():
        starts[r["part"], r["old_shard"]] = old[r["old_shard"]]
        old[r["old_shard"]] += r["size"]
    flow = transfers(old, capacity or even_capacities(sum(old), shards))
    edges = {}
    for i, line in enumerate(flow):
        to = [i, *(j for j in range(shards) if j != i and line[j])] if line[i] else [j for j in range(shards) if line[j]]
        edges[i] = (np.cumsum([line[j] for j in to]), np.array(to or [i], np.int32))
    # in a partition the rows of an old shard that go to the same new one are a run of numbers; runs follow in slots
    new = running.mapInArrow(_assigned(starts, edges), "id long, old_shard int, shard int")
    runs = new.groupBy(F.shiftright("id", 33).alias("piece"), "old_shard", "shard").agg(
        F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")
    )
    begin: list[tuple[int, int, int, int, int, int]] = []
    filled = [0] * shards
    for r in runs.orderBy("first").collect():
        begin.append((r["piece"], r["old_shard"], r["first"], r["last"], r["shard"], filled[r["shard"]] - r["first"]))
        filled[r["shard"]] += r["n"]
    ddl = "piece long, old_shard int, first long, last long, shard int, offset long"
    # broadcast, so that rows stay where they are and in order; a few rows for each partition and shard
    runs = F.broadcast(spark.createDataFrame(begin, ddl))
    placed = sorted_.withColumn("piece", F.shiftright("id", 33)).join(runs, ["piece", "old_shard"])
    placed = placed.where(F.col("id").between(F.col("first"), F.col("last")))
    slot = (F.col("id") + F.col("offset")).alias("slot")
    return scratch.finish(placed.select("doc_id", "size", "text_crc32", "old_shard", "shard", slot, "row"))


def _digest(text: Column) -> list[Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ]


def _added(docs: DataFrame) -> list[str]:
    """Names for shard, slot and old shard in the files, other than those of the documents' columns."""
    return free_names(docs, "shard", "slot", "old_shard")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, places: bool = False) -> list[int]:
    """Write the files of the shards that gain or lose rows under ``path/shard=N``; the others stay as they are.

    ``placed`` is what ``resharded`` made of ``docs`` and carries their rows, so null and repeated doc_ids are rows like
    any other. A shard is as many files as tasks hold rows of it, each a run of slots in order; ``places`` adds the
    columns slot and old_shard to them. Every column of ``docs`` is written: where one has the name of an added column,
    the added one gets an underscore before it. A shard that has lost all its rows is removed. Returns the shards that
    changed.
    """
    moved = placed.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    changed = sorted(r[0] for r in moved.collect())
    shard, slot, old = _added(docs)
    rows = placed.where(F.col("shard").isin(changed)).sortWithinPartitions("shard", "slot")
    more = [F.col("slot").alias(slot), F.col("old_shard").alias(old)] if places else []
    rows = rows.select(*(F.col("row")[c].alias(c) for c in docs.columns), *more, F.col("shard").alias(shard))
    rows.write.partitionBy(shard).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    filled = {r[0] for r in placed.select("shard").distinct().collect()}
    for s in set(changed) - filled:
        target = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/{shard}={s}")
        target.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
    return changed


def resharded_files(docs: DataFrame, old_shard: Column, path: str, shards: int = 8) -> DataFrame:
    """``resharded`` without the rows, after writing the affected shards to ``path``; theirs is read from the files.

    Only affected shards are written: in an empty folder those that kept all their rows have no files.
    """
    placed = resharded(docs, old_shard, shards)
    changed = write_shards(docs, placed, path, places=True)
    names = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot"]
    same = placed.where(~F.col("shard").isin(changed)).select(*names)
    if not changed:
        return same
    shard, slot, old = _added(docs)
    schema = StructType(docs.schema.fields).add(slot, "long").add(old, "integer").add(shard, "integer")
    files = docs.sparkSession.read.schema(schema).parquet(path)
    added = [F.col(old).alias("old_shard"), F.col(shard).alias("shard"), F.col(slot).alias("slot")]
    return files.select(F.col("doc_id").cast("long").alias("doc_id"), *_digest(F.col("text")), *added).union(same)
