"""Helpers shared by the operators: scratch tables, word hashes over Arrow strings, running ranks."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubmeta.sources.workspace import new_folder

SPACES = "[\\x20\\x09-\\x0D]"
#: Bytes of text that are hashed at once; a longer document is hashed on its own.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


class Scratch:
    """Tables of one operator run in the shared folder; ``finish`` keeps only the result."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.label = label
        self._paths: list[str] = []
        self._names: list[str] = []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        path = new_folder(self.spark, f"{self.label}-{label}")
        df.write.parquet(path)
        self._paths.append(path)
        schema = df.schema
        del df
        self.release()
        return self.spark.read.schema(schema).parquet(path)

    def bucketed(self, df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
        """A table in hash buckets of a key: joins and groups by the key read it without a shuffle."""
        path = new_folder(self.spark, f"{self.label}-{label}")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
        self._paths.append(path)
        self._names.append(name)
        return self.spark.table(name)

    def release(self) -> None:
        """Shuffle files go when nothing refers to their plan any more; the cleaner learns that from a collection."""
        gc.collect()
        self.spark._jvm.System.gc()

    def finish(self, df: DataFrame) -> DataFrame:
        earlier, self._paths = self._paths, []
        out = self.table(df, "result")
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.remove(earlier)
        return out

    def drop_all_but_last(self) -> None:
        earlier, self._paths = self._paths[:-1], self._paths[-1:]
        self.remove(earlier)

    def remove(self, paths: list[str]) -> None:
        for path in paths:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a few numbers each that may be broadcast (about 20 MB as a hash table); beyond it a join is shuffled.
SMALL_ROWS = 200_000


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with underscores before them until no column of the table has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(rows: DataFrame, gone: DataFrame, same: Callable[[DataFrame], Column]) -> DataFrame:
    """Rows that none of ``gone``, a stored table of keys, matches.

    Up to SMALL_ROWS keys are broadcast and the rows are not shuffled at all. More are shuffled with the rows into
    hash tables of keys, past which the rows stream unsorted.
    """
    gone = gone.alias("gone")
    gone = F.broadcast(gone) if gone.count() <= SMALL_ROWS else gone.hint("shuffle_hash")
    return rows.join(gone, same(gone), "left_anti")


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACES}+|{SPACES}+$", "")
    parts = F.size(F.split(trimmed, f"{SPACES}+"))
    return F.when(trimmed == "", F.lit(0)).otherwise(parts).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def crc32_text(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """The first n values of a fixed random sequence."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_POSITION = stream(64, 7) | np.uint64(1)


def _position(n: int) -> np.ndarray:
    global _POSITION
    if n > len(_POSITION):
        _POSITION = stream(max(n, 2 * len(_POSITION)), 7) | np.uint64(1)
    return _POSITION


def _buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    text = text.cast(pa.large_string()) if not pa.types.is_large_string(text.type) else text
    bufs = text.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each lower-cased (A-Z) word, and where each document's words begin (one more than documents).

    A word is hashed as the sum of its bytes times random odd numbers by position, then mixed.
    """
    data, offsets = _buffers(text)
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    space = _SPACE[data]
    begins = np.empty(len(data), bool)
    begins[0] = True
    begins[1:] = space[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    values = _LOWER[data[starts[0] :]] + np.uint64(1)
    values[space[starts[0] :]] = 0
    inside = ~space[starts[0] :]
    longest = int(place[inside].max()) + 1
    values *= _position(longest)[np.minimum(place, longest - 1)]
    hashes = mix(np.add.reduceat(values, starts - starts[0]))
    return hashes, np.searchsorted(starts, offsets, "left")


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about CHUNK_BYTES of text, null texts made empty."""
    i = batch.schema.get_field_index(column)
    text = batch.column(i).cast(pa.large_string()).fill_null("")
    batch = pa.RecordBatch.from_arrays(
        [text if k == i else c for k, c in enumerate(batch.columns)], names=batch.schema.names
    )
    _, offsets = _buffers(text)
    start = 0
    while start < len(text):
        end = int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, start + 1), len(text))
        yield batch.slice(start, end - start)
        start = end


def groups_of(
    batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], each: Callable[[pa.Table], pa.Table | None]
) -> Iterator[pa.RecordBatch]:
    """Call ``each`` on the groups of at least two rows of a partition that is sorted by the keys.

    Groups may span batches. This is for very many small groups, for which a Python call per group through the
    engine costs more than the work.
    """

    def cut(table: pa.Table, final: bool) -> tuple[list[pa.Table], pa.Table | None]:
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in keys:
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(change), table.num_rows]
        upto = len(cuts) - 1 if final else len(cuts) - 2
        found = [table.slice(lo, hi - lo) for lo, hi in zip(cuts[:upto], cuts[1 : upto + 1], strict=True) if hi - lo > 1]
        results = [r for r in map(each, found) if r is not None and r.num_rows]
        return results, None if final else table.slice(cuts[-2])

    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if carry is None else pa.concat_tables([carry, table])
        results, carry = cut(table.combine_chunks(), False)
        if results:
            yield from pa.concat_tables(results).combine_chunks().to_batches()
    if carry is not None:
        results, _ = cut(carry.combine_chunks(), True)
        if results:
            yield from pa.concat_tables(results).combine_chunks().to_batches()
