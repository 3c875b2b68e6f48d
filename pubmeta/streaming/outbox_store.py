"""An outbox stored by status: open messages in slots of their age, published ones apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pubmeta.operators.outbox import BATCH, outbox_transition, pending_outbox
from pubmeta.schemas import PUBLISHED
from pubmeta.sources.workspace import stored

SLOT = "_slot"
#: Open messages of a slot. A tick reads and rewrites the slots that it takes messages from.
SLOT_ROWS = 50_000
_STAMP = "yyyyMMddHHmmssSSSSSS"


@dataclass(frozen=True)
class OutboxStore:
    """``root/open`` holds messages that are not published, in one partition per slot; ``root/ticks`` what each tick
    changed; published messages are the ticks' rows and what was published when the store was filled (``root/done``).

    A slot's name begins with the time of its oldest message, so names alone tell which slots can hold the oldest
    messages. Slots may overlap in time: messages may be added late.
    """

    spark: SparkSession
    root: str

    def add(self, messages: DataFrame) -> None:
        """File messages by their status; open ones are cut by age into slots of about SLOT_ROWS."""
        for name, kind in (("last_error", "string"), ("published_at", "timestamp")):
            if name not in messages.columns:
                messages = messages.withColumn(name, F.lit(None).cast(kind))
        rows = stored(messages, "outbox-added")
        rows.where(F.col("status") == PUBLISHED).write.mode("append").parquet(f"{self.root}/done")
        self._file(rows.where(F.col("status") != PUBLISHED), "append")

    def _file(self, rows: DataFrame, mode: str) -> None:
        parts = max(1, -(-rows.count() // SLOT_ROWS))
        dealt = rows.repartitionByRange(parts, "created_at", "id").withColumn("_part", F.spark_partition_id())
        dealt = stored(dealt, "outbox-dealt")
        oldest = dealt.groupBy("_part").agg(F.min("created_at").alias("oldest"))
        name = F.concat_ws("-", F.coalesce(F.date_format("oldest", _STAMP), F.lit("0")), F.lit("s"), F.col("_part").cast("string"), F.expr("uuid()"))
        names = stored(oldest.select("_part", name.alias(SLOT)), "outbox-slots")
        filed = dealt.join(names, "_part").drop("_part")
        filed.repartition(SLOT).sortWithinPartitions("created_at", "id").write.mode(mode).partitionBy(SLOT).parquet(f"{self.root}/open")

    def slots(self) -> list[str]:
        """Names of the slots with messages, the one with the oldest message first; listed, not read."""
        if not self._exists("open"):
            return []
        path = self._path("open")
        found = [f.getPath().getName() for f in path.getFileSystem(self._conf()).listStatus(path)]
        return sorted(f.removeprefix(f"{SLOT}=") for f in found if f.startswith(f"{SLOT}="))

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def _exists(self, *parts: str) -> bool:
        path = self._path(*parts)
        return path.getFileSystem(self._conf()).exists(path)

    def open_rows(self, slots: list[str]) -> DataFrame:
        """Messages of some slots: a scan of their partitions only."""
        return self.spark.read.parquet(f"{self.root}/open").where(F.col(SLOT).isin(slots))

    def pending(self, n: int = BATCH) -> tuple[DataFrame | None, list[str]]:
        """The ``n`` oldest open messages, if there are any, and the slots that had to be read: as many as can hold one
        of them."""
        slots, take = self.slots(), 1
        while slots:
            read, rest = slots[:take], slots[take:]
            oldest = pending_outbox(self.open_rows(read), n).drop(SLOT)
            if not rest:
                return oldest, read
            newest = oldest.agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("created_at"), _STAMP).alias("t")).first()
            if newest["n"] == n and newest["t"] is not None and newest["t"] < rest[0].split("-s-")[0]:
                return oldest, read
            take *= 2
        return None, []

    def tick(
        self, batch_id: int, send: Callable[[DataFrame], DataFrame], now: Column, n: int = BATCH
    ) -> DataFrame | None:
        """Publish the oldest pending messages and move those that went out; returns the changed rows.

        The changes are written under the tick's id before any slot is touched. A tick that is replayed after that only
        moves them again; one that is replayed before sends again, as at-least-once delivery allows.
        """
        path = f"{self.root}/ticks/batch_id={batch_id}"
        if not self._exists("ticks", f"batch_id={batch_id}", "_SUCCESS"):
            chosen, _ = self.pending(n)
            if chosen is None:
                return None
            chosen = stored(chosen, "outbox-chosen")
            outbox_transition(chosen, send(chosen), now).write.mode("overwrite").parquet(path)
        changed = self.spark.read.parquet(path)
        newest = changed.agg(F.date_format(F.max("created_at"), _STAMP).alias("t")).first()["t"]
        old = self.open_rows([s for s in self.slots() if newest is None or s.split("-s-")[0] <= newest])
        touched = [r[SLOT] for r in old.join(changed.select("id"), "id", "left_semi").select(SLOT).distinct().collect()]
        if touched:
            old = self.open_rows(touched)
            failed = changed.where(F.col("status") != PUBLISHED)
            # a message that is still open keeps its slot, so an untouched slot is never written
            places = old.select("id", SLOT).join(failed.select("id"), "id", "left_semi")
            left = old.join(changed.select("id"), "id", "left_anti")
            new = left.unionByName(failed.join(places, "id").select(*old.columns))
            self._replace(stored(new, "outbox-slots"), touched)
        return changed

    def _replace(self, rows: DataFrame, slots: list[str]) -> None:
        """New content of slots; a slot without messages goes."""
        writer = rows.repartition(SLOT).sortWithinPartitions("created_at", "id").write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(SLOT).parquet(f"{self.root}/open")
        left = {r[SLOT] for r in rows.select(SLOT).distinct().collect()}
        for slot in slots:
            if slot not in left:
                path = self._path("open", f"{SLOT}={slot}")
                path.getFileSystem(self._conf()).delete(path, True)

    def published(self) -> DataFrame:
        """Messages that are published, each once."""
        parts = [
            self.spark.read.parquet(f"{self.root}/{p}").where(F.col("status") == PUBLISHED).drop("batch_id")
            for p in ("done", "ticks")
            if self._exists(p)
        ]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def publish_store(
    ticks: DataFrame,
    store: OutboxStore,
    send: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    n: int = BATCH,
    interval: str = "5 seconds",
    now: Column | None = None,
) -> DataStreamWriter:
    """On every tick publish the oldest pending messages of the store; its cost follows the slots they lie in."""
    stamp = F.current_timestamp() if now is None else now

    def run(_: DataFrame, batch_id: int) -> None:
        store.tick(batch_id, send, stamp, n)

    return (
        ticks.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
    )
