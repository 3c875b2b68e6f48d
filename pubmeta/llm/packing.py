"""Best-fit packing of token sequences in bulk-synchronous steps over length classes."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeta.llm.common import Scratch, chunks

CAPACITY = 1024
#: Vocabulary of the public byte-level tokenizer, as ranks; ``byte_bpe_50k.json`` holds the same ids.
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = ("<|endoftext|>", 50256)
#: Id that ends every document.
END_ID = 2

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict([SPECIAL])
    )


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of the text, the special token's string taken as that token, and the end id."""
    ids = _encoder(path).encode(text, allowed_special="all", disallowed_special=())
    return np.array([*ids, END_ID], "<u4")


def _pieces(path: str, capacity: int):
    """Documents cut so that only the first piece may be shorter than the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = token_ids(text, path)
                    first = len(ids) % capacity or capacity
                    starts = [0, *range(first, len(ids), capacity)]
                    for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        row = (doc_id, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()))
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


Match = tuple[int, int, int, int, int]


def best_fit(counts: dict[int, int], capacity: int) -> dict[int, list[Match]]:
    """Match length classes to gap classes; per length the matches ``(rank from, rank to, first bin, per bin, offset)``.

    Documents of one length are told apart by rank only, and so are bins of one gap, which come as ranges of bin
    numbers. A step takes the next shorter length and sweeps the gaps upward from its successor, the smallest gap
    that holds it. Each bin of a range takes as many documents as fit, in order of rank; its gap shrinks and it goes
    back under its new gap for the next step. When no gap is left, bins are opened. This is best-fit decreasing with
    equal documents taken together, and its state has a bound in the capacity alone, however many documents there
    are: a step uses up whole ranges but one, and adds three at most.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    opened = 0
    plan: dict[int, list[Match]] = {}

    def add(gap: int, lo: int, hi: int) -> None:
        if gap and hi > lo:
            if gap not in gaps:
                gaps[gap] = []
            gaps[gap].append((lo, hi))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        matches = plan.setdefault(length, [])
        sizes = [g for g in gaps if g >= length]
        heapq.heapify(sizes)
        while left:
            while sizes and not gaps.get(sizes[0]):
                gaps.pop(heapq.heappop(sizes), None)
            if not sizes:
                bins = -(-left // (capacity // length))
                add(capacity, opened, opened + bins)
                opened += bins
                sizes = [capacity]
            gap = sizes[0]
            lo, hi = gaps[gap].pop()
            per = min(gap // length, left)
            bins = min(hi - lo, left // per)
            matches.append((rank, rank + bins * per, lo, per, capacity - gap))
            rank, left = rank + bins * per, left - bins * per
            add(gap, lo + bins, hi)
            # it holds no more of this length unless the documents have run out
            add(gap - per * length, lo, lo + bins)
    return plan


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range-sorted partition with their place among those of their length in it."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        nth = np.empty(len(lengths), np.int64)
        cuts = np.flatnonzero(np.diff(lengths, prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(lengths)), strict=True):
            before = seen.get(int(lengths[lo]), 0)
            nth[lo:hi] = before + np.arange(hi - lo)
            seen[int(lengths[lo])] = before + int(hi - lo)
        names = [*batch.schema.names, "part", "nth"]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(nth)], names=names
        )


def _placed(offsets: dict[tuple[int, int], int], plan: dict[int, list[Match]]):
    arrays = {length: np.array(matches, np.int64).reshape(-1, 5).T for length, matches in plan.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            parts = batch.column("part").to_numpy()
            rank = batch.column("nth").to_numpy().copy()
            sequence, place = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                for p in np.unique(parts[at]):
                    rank[at[parts[at] == p]] += offsets[int(p), int(length)]
                begin, _, first, per, used = arrays[int(length)]
                m = np.searchsorted(begin, rank[at], "right") - 1
                within = rank[at] - begin[m]
                sequence[at] = first[m] + within // per[m]
                place[at] = used[m] + within % per[m] * length
            keep = [batch.column(f.split()[0]) for f in _PIECES.split(", ")]
            names = [f.split()[0] for f in _PIECES.split(", ")] + ["sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(place)], names=names)

    return run


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, ranks: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens, as few as best-fit decreasing needs.

    Takes ``doc_id long, text`` (more columns are ignored) and returns one row per piece: ``doc_id, piece, start,
    length, ids_crc32, sequence_id, offset``. A null text is an empty one: it has the end id only. Null and repeated
    doc_ids are packed row by row. Equal lengths are ranked by the sort, where a random number settles ties. An empty
    table gives an empty result. ``ranks`` is the path of the vocabulary.

    The pieces are range-sorted by length, so a length that very many documents share is spread over partitions. What
    is matched are classes of equal length and equal gap, at most ``capacity`` of either (``best_fit``); the driver
    sees the counts per class and partition and no row. A piece finds its sequence by its rank in its class.
    """
    path = ranks or tokenizer_path(RANKS)
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.table(text.mapInArrow(_pieces(path, capacity), _PIECES).withColumn("tie", F.rand(7)), "pieces")
    ordered = pieces.repartitionByRange("length", "tie").sortWithinPartitions("length", "tie")
    ranked = scratch.table(ordered.mapInArrow(_numbered, f"{_PIECES}, tie double, part int, nth long"), "ranked")
    offsets: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for r in ranked.groupBy("part", "length").count().orderBy("part").collect():
        offsets[r["part"], r["length"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    placed = ranked.mapInArrow(_placed(offsets, best_fit(counts, capacity)), f"{_PIECES}, sequence_id long, offset long")
    return scratch.finish(placed)
