"""Exact duplicates: counting quotient filters find repeated fingerprints, equal bytes decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmeta.llm.common import SPACES, Scratch, free_names, without

#: A filter is cut into blocks of consecutive quotients, which are what is shuffled and merged: at least
#: 2**BLOCK_BITS of them, and so many more that a block merges about BLOCK_ROWS fingerprints of the whole table.
BLOCK_BITS = 8
BLOCK_ROWS = 1 << 20
#: Bits of the quotient: a slot for each row of a full filter. The other bits of the 64 are the remainder.
QUOTIENT_BITS = 20
#: Rows after which a partition hands on its filter and begins another.
FILTER_ROWS = 1 << QUOTIENT_BITS

_BLOCK = "block int, quotients binary, remainders binary, counts binary"


def block_bits(rows: int) -> int:
    return max(BLOCK_BITS, (rows // BLOCK_ROWS).bit_length())


def _slot_bits(bits: int) -> int:
    return max(QUOTIENT_BITS - bits, 2)


def _encode(fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Blocks of a filter from sorted distinct fingerprints: run lengths by quotient, remainders, counts."""
    slots = _slot_bits(bits)
    block = (fingerprints >> np.uint64(64 - bits)).astype(np.int64)
    inner = 64 - bits - slots
    quotient = ((fingerprints >> np.uint64(inner)) & np.uint64((1 << slots) - 1)).astype(np.int64)
    remainder = fingerprints & np.uint64((1 << inner) - 1)
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(block)), strict=True):
        runs = np.bincount(quotient[lo:hi], minlength=1 << slots).astype(np.uint32)
        yield int(block[lo]), runs.tobytes(), remainder[lo:hi].tobytes(), counts[lo:hi].astype(np.int64).tobytes()


def _decode(block: int, quotients: bytes, remainders: bytes, counts: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    runs = np.frombuffer(quotients, np.uint32)
    quotient = np.repeat(np.arange(len(runs), dtype=np.uint64), runs)
    inner = np.uint64(64 - bits - _slot_bits(bits))
    high = np.uint64(block) << np.uint64(64 - bits)
    return high | (quotient << inner) | np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.int64)


def _merge(fingerprints: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge runs that are sorted by quotient and remainder; counts of equal ones add up, so nothing is lost."""
    keys, n = np.concatenate(fingerprints), np.concatenate(counts)
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")  # sorted runs are merged, not sorted again
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def _build(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            columns = list(zip(*_encode(keys, n, bits), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                names=["block", "quotients", "remainders", "counts"],
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                rows += batch.num_rows
            if rows >= FILTER_ROWS:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    return run


def _repeated(bits: int):
    def run(table: pa.Table) -> pa.Table:
        """Merge the filters of one block; hand on the fingerprints counted more than once."""
        parts = [_decode(*row.values(), bits) for row in table.to_pylist()]
        keys, n = _merge([p[0] for p in parts], [p[1] for p in parts])
        return pa.table({"fingerprint": keys[n > 1].view(np.int64), "rows": n[n > 1]})

    return run


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """``(fingerprint, rows)`` of the 64-bit fingerprints in the first column that occur more than once.

    The column is read twice, first to count its rows: the number of blocks follows from them.
    """
    bits = block_bits(fingerprints.count())
    blocks = fingerprints.mapInArrow(_build(bits), _BLOCK)
    return blocks.groupBy("block").applyInArrow(_repeated(bits), "fingerprint long, rows long")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACES}+", "")


_IDS = (1 << 63) - 1
_STEP = str(10**20)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Which of the documents with the same text stays.

    Takes ``doc_id long, text`` (more columns are ignored) and returns ``doc_id, keep_id, group_size, kept,
    text_sha256``, one row per input row. Texts are equal when they are the same bytes without white space; a null
    text is an empty one, and all empty texts are one group. The longest original (in code points) stays, then the
    smallest doc_id. A null doc_id comes after every other; rows that repeat a doc_id and its text count towards
    group_size and are all marked as kept if that id stays (``distinct_texts`` leaves one of them). An empty table
    gives an empty result.

    The counting quotient filters are built per partition and merged block by block. Only rows whose fingerprint is
    counted more than once send their text through a shuffle, where grouping by the text itself compares its bytes;
    the grouping combines on the map side, so a large group of copies is a few rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    return scratch.finish(_judged(docs, scratch).drop("fingerprint", "second"))


def _hashes(norm: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a normalised text, by which a row is found again next to its id."""
    return F.xxhash64(norm), F.xxhash64(F.lit(9), norm)


def _judged(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``exact_duplicates`` with both hashes of each row's text."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    norm = normalised(F.col("_t"))
    light = scratch.table(
        base.select(
            "doc_id",
            F.char_length("_t").cast("long").alias("_chars"),
            _hashes(norm)[0].alias("fingerprint"),
            _hashes(norm)[1].alias("second"),
            F.sha2(norm.cast("binary"), 256).alias("text_sha256"),
        ),
        "light",
    )
    repeated = scratch.table(repeated_fingerprints(light.select("fingerprint")), "repeated")

    step = F.lit(_STEP).cast("decimal(21,0)")
    rank = (
        F.char_length("_t").cast("decimal(10,0)") * step
        + (F.lit(_IDS).cast("decimal(20,0)") - F.coalesce("doc_id", F.lit(_IDS)).cast("decimal(20,0)"))
    ).cast("decimal(38,0)")
    routed = (
        base.withColumn("fingerprint", F.xxhash64(norm))
        .join(repeated.select("fingerprint"), "fingerprint", "left_semi")
        .select(norm.alias("norm"), rank.alias("rank"), "doc_id")
    )
    groups = scratch.table(
        routed.groupBy("norm")
        .agg(F.max("rank").alias("rank"), F.count("*").alias("group_size"), F.count("doc_id").alias("_ids"))
        .where("group_size > 1")
        .select(
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.when(
                F.col("_ids") > 0,
                (F.lit(_IDS) - (F.col("rank") % step).cast("decimal(21,0)")).cast("long"),
            ).alias("keep_id"),
            "group_size",
            F.lit(True).alias("_in_group"),
        ),
        "groups",
    )
    return light.join(groups, "text_sha256", "left").select(
        "doc_id",
        "fingerprint",
        "second",
        F.when(F.col("_in_group"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("_in_group"), F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(True).alias("kept"),
        "text_sha256",
    )


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names.

    Rows are told apart by doc_id and normalised text, so neither a null doc_id nor one that is used twice takes
    another text with it. Of rows that repeat a kept id and text one with the longest original stays; where those tie
    and differ in other columns, any of them. Null and empty texts are one group. An empty table gives an empty result.

    Ids and hashes decide. Whole texts are shuffled only to drop rows from a table with more of them than may be
    broadcast (``without``), and to choose among rows that repeat a kept id and text, which combines on the map side.
    """
    scratch = Scratch(docs.sparkSession, "distinct")
    key = ["doc_id", "fingerprint", "second"]
    judged = scratch.table(_judged(docs, scratch).select(*key, "group_size", "kept"), "judged")
    several = judged.where("kept and group_size > 1").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    several = scratch.table(several.select(*key), "several")
    aside = scratch.table(judged.where("not kept").select(*key).distinct().union(several), "aside")

    columns = [F.col(f"`{c}`") for c in docs.columns]
    first, second = free_names(docs, "_first", "_second")
    hashes = _hashes(normalised(F.col("text")))
    keyed = docs.withColumns({first: hashes[0], second: hashes[1]})

    def same(other: DataFrame) -> Column:
        return (
            keyed["doc_id"].eqNullSafe(other["doc_id"])
            & (keyed[first] == other["fingerprint"])
            & (keyed[second] == other["second"])
        )

    rest = without(keyed, aside, same).select(*columns)
    if several.isEmpty():
        return rest
    longest = F.max_by(F.struct(*columns), F.char_length(F.coalesce("text", F.lit(""))))
    chosen = keyed.join(several, same(several), "left_semi").groupBy("doc_id", first, second).agg(longest.alias("_row"))
    return rest.unionByName(chosen.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))
