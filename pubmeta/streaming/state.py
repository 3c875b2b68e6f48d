"""Keys that are finished, kept in a state store that is looked up by key."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The processor travels with the query, so neither executors nor Spark's own Python runner need this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Names of columns on their way through the store; Spark renames those that begin with an underscore.
_FINISHED = "finished"


def use_keyed_state(spark: SparkSession) -> None:
    """Let streams that are started from now on keep their state in RocksDB: on disk, read and written by key."""
    spark.conf.set(PROVIDER_SETTING, ROCKSDB)


#: Groups that keys are dealt to. A group is one call per micro-batch, in which each key is one lookup; calls cost
#: far more than lookups. The number is part of a stream's checkpoint.
GROUPS = 4096


class SkipFinished(StatefulProcessor):
    """Hands on the distinct rows of keys that are not finished; a finished key has one entry in its group's map."""

    def __init__(self, key: T.DataType):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = T.StructType([T.StructField("k", self.key)]), T.StructType([T.StructField("yes", T.BooleanType())])
        self.finished = handle.getMapState("finished", *kinds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting: pd.DataFrame | None = None
        now: set = set()
        for frame in rows:
            if frame.empty:  # a group that only the initial state has
                continue
            now.update(self._note(frame.loc[frame[_FINISHED], "k"]))
            # repeats collapse as they arrive, so what is held are the group's distinct rows of the micro-batch
            frame = frame[~frame[_FINISHED]]
            waiting = frame if waiting is None else pd.concat([waiting, frame], ignore_index=True)
            waiting = waiting.drop_duplicates()
        if waiting is None or not len(waiting):
            return
        open_ = [k for k in waiting["k"].unique().tolist() if k not in now and not self.finished.containsKey((k,))]
        waiting = waiting[waiting["k"].isin(open_)]
        if len(waiting):
            yield waiting.drop(columns=_FINISHED)

    def _note(self, keys: pd.Series) -> list:
        found = keys.unique().tolist()
        for k in found:
            self.finished.updateValue((k,), (True,))
        return found

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._note(initialState["k"])

    def close(self) -> None:
        pass


def _without_repeats(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.drop_duplicates()


def skip_finished(
    events: DataFrame,
    finished: DataFrame,
    key: str,
    payload: list[str],
    before: DataFrame | None = None,
    groups: int = GROUPS,
) -> DataFrame:
    """Distinct ``(key, *payload)`` of streamed events whose key is not finished.

    ``finished`` is a stream of finished keys, usually the job's own results: rows of a key that arrive in the same
    micro-batch come before its events. ``before`` are keys finished before the stream began; they seed the store
    in its first micro-batch and are not read again. A micro-batch then reads its own rows and one entry per key,
    whatever the length of the history. Null keys are left out. Repeats collapse before the shuffle, batch by batch,
    so a key that very many events name sends few rows to its task.
    """
    kinds = [events.schema[c].dataType for c in (key, *payload)]
    # as text on their way through Python, where a column of integers with nulls would turn into doubles
    texts = {f"p{i}": F.col(c).cast("string") for i, c in enumerate(payload)}
    group = F.pmod(F.xxhash64(F.col(key).cast(kinds[0])), F.lit(groups)).cast("int").alias("g")
    own = F.col(key).cast(kinds[0]).alias("k")
    rows = events.where(F.col(key).isNotNull())
    rows = rows.select(group, own, *[c.alias(n) for n, c in texts.items()], F.lit(False).alias(_FINISHED))
    empty = [F.lit(None).cast("string").alias(n) for n in texts]
    done = finished.where(F.col(key).isNotNull())
    rows = rows.unionByName(done.select(group, own, *empty, F.lit(True).alias(_FINISHED)))
    rows = rows.mapInPandas(_without_repeats, rows.schema)
    if before is not None:
        before = before.where(F.col(key).isNotNull()).select(group, own).distinct().groupBy("g")
    waiting = rows.groupBy("g").transformWithStateInPandas(
        statefulProcessor=SkipFinished(kinds[0]),
        outputStructType=T.StructType([f for f in rows.schema if f.name != _FINISHED]),
        outputMode="Append",
        timeMode="None",
        initialState=before,
    )
    return waiting.select(
        F.col("k").alias(key), *[F.col(f"p{i}").cast(k).alias(c) for i, (c, k) in enumerate(zip(payload, kinds[1:], strict=True))]
    )
