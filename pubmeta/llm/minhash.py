"""Near duplicates of word shingles by HyperMinHash sketches, banding, and a check on whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubmeta.llm.common import Scratch, chunks, free_names, groups_of, mix, stream, without, word_hashes
from pubmeta.llm.components import connected_components

#: Registers of a sketch, of one byte.
REGISTERS = 512
#: The first registers make the bands. A pair at similarity 0.8 shares none of the 32 bands of 5 registers with
#: probability (1 - 0.8**5)**32 = 3e-6.
BANDS = 32
BAND = 5
#: Mantissa bits kept after the leading one; the other six bits are the leading zeros.
MANTISSA = 2
#: Rounds of one hash for all registers; registers still empty then get a hash of their own.
ROUNDS = 8
#: Expected share of registers that agree by collision only (0.1699 / 2**MANTISSA for sets of like size).
COLLISION = 0.169919487159739093975315012348 / (1 << MANTISSA)
#: A candidate goes on when its estimate is at least the threshold less this; 4.1 standard deviations at 0.8.
MARGIN = 0.075
#: Members of a bucket that are compared at once.
PIECE = 256

_ROUND = stream(ROUNDS, 2)
_OWN = stream(REGISTERS, 3)
_BAND_WEIGHT = stream(BAND, 4) | np.uint64(1)
_BAND_SALT = stream(BANDS, 5)


def shingle_sets(text: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each document's shingles; a shorter text is one shingle, an empty one none."""
    hashes, begin = word_hashes(text)
    weight = stream(words, 1) | np.uint64(1)
    rolled = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled += hashes[k : k + len(rolled)] * weight[k]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(begin[:-1], begin[1:], strict=True):
        n = hi - lo
        if n >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif n:
            out.append(mix(np.array([np.sum(hashes[lo:hi] * weight[:n]) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _compress(values: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Leading zeros of 32-bit values (6 bits) and the MANTISSA bits after the leading one; rounds shift the code."""
    mantissa, exponent = np.frexp((values + np.uint64(1)).astype(np.float64))
    code = ((33 - exponent) << MANTISSA) | ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return ((code + rounds * 37) & 0xFF).astype(np.uint8)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of one set, all filled.

    In a round every shingle falls into one bucket, which keeps the smallest value. Buckets that stay empty take the
    value of the next round; after ROUNDS of them each empty bucket uses a hash of its own. A register of a union is
    thus the one of either set, and two registers agree with the Jaccard similarity as probability.
    """
    values = np.full(REGISTERS, np.uint64(1 << 32))
    rounds = np.zeros(REGISTERS, np.int64)
    empty = np.ones(REGISTERS, bool)
    low = np.uint64(0xFFFFFFFF)
    for r in range(ROUNDS):
        x = mix(shingles ^ _ROUND[r])
        bucket = ((x >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        found = np.full(REGISTERS, np.uint64(1 << 32))
        np.minimum.at(found, bucket.astype(np.int64), x & low)
        new = empty & (found <= low)
        values[new], rounds[new] = found[new], r
        empty &= ~new
        if not empty.any():
            break
    own = np.flatnonzero(empty)
    if len(own):
        values[own] = (mix(shingles[None, :] ^ _OWN[own][:, None]) & low).min(axis=1)
        rounds[own] = ROUNDS
    return _compress(values, rounds)


def bands(registers: np.ndarray) -> np.ndarray:
    grouped = registers[: BANDS * BAND].reshape(BANDS, BAND).astype(np.uint64)
    return mix((grouped * _BAND_WEIGHT).sum(axis=1, dtype=np.uint64) ^ _BAND_SALT).view(np.int64)


def estimate(a: bytes, b: bytes) -> float:
    """Jaccard similarity by agreeing registers, less those expected to agree by collision."""
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / REGISTERS
    return max(0.0, (same - COLLISION) / (1 - COLLISION))


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                sets = shingle_sets(batch.column("text"), words)
                with np.errstate(over="ignore"):
                    first = [np.bitwise_xor.reduce(mix(s ^ _OWN[0])).astype(np.int64) if len(s) else 0 for s in sets]
                    second = [np.sum(mix(s ^ _OWN[1]), dtype=np.uint64).astype(np.int64) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("row"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(first, pa.int64()),
                        pa.array(second, pa.int64()),
                        pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "row", "n_shingles", "set_a", "set_b", "registers"],
                )

    return run


def _explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [bands(np.frombuffer(r, np.uint8)) for r in batch.column("registers").to_pylist()]
        if found:
            ids = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(ids)], names=["band", "node"])


def _compare(threshold: float):
    """Pairs of a bucket's pieces that lie in different components and are near by estimate.

    A pair is given only in the first band that it shares.
    """
    least = int(np.floor((COLLISION + threshold * (1 - COLLISION)) * REGISTERS))

    def run(table: pa.Table) -> pa.Table | None:
        side = table.column("side").to_numpy()
        same = table.column("kind")[0].as_py() == 0 and table.column("p")[0].as_py() == table.column("q")[0].as_py()
        left = np.arange(len(side)) if same else np.flatnonzero(side == 0)
        right = np.arange(len(side)) if same else np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return None
        node, part = table.column("node").to_numpy(), table.column("part").to_numpy()
        registers = np.vstack([np.frombuffer(r, np.uint8) for r in table.column("registers").to_pylist()])
        found = []
        for i in left:
            j = right[(part[right] != part[i]) & ((right > i) if same else True)]
            j = j[(registers[j] == registers[i]).sum(axis=1) >= least]
            if len(j):
                found.append(np.column_stack([np.full(len(j), i), j]))
        if not found:
            return None
        i, j = np.concatenate(found).T
        used = np.unique(np.concatenate([i, j]))
        keys = np.zeros((len(node), BANDS), np.int64)
        keys[used] = [bands(registers[u]) for u in used]
        shared = keys[i] == keys[j]
        first = keys[i][np.arange(len(i)), shared.argmax(axis=1)] == table.column("band")[0].as_py()
        a, b = node[i[first]], node[j[first]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return lambda batches: groups_of(batches, ("band", "kind", "p", "q"), run)


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("ra").to_pylist(), batch.column("rb").to_pylist(), strict=True)
        found = pa.array([estimate(a, b) for a, b in pairs], pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), found], names=["a", "b", "estimate"])


def _verified(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                a, left = part.column("a").to_pylist(), part.column("ta")
                fresh = [k for k, x in enumerate(a) if k == 0 and x not in known or k and x != a[k - 1]]
                sets = shingle_sets(left.take(pa.array(fresh, pa.int32())).fill_null(""), words) if fresh else []
                last = known
                known = last | {a[k]: s for k, s in zip(fresh, sets, strict=True)}
                linked = []
                for x, s in zip(a, shingle_sets(part.column("tb").fill_null(""), words), strict=True):
                    both = len(np.intersect1d(known[x], s, assume_unique=True))
                    union = len(known[x]) + len(s) - both
                    linked.append(union > 0 and 100 * both >= percent * union)
                known = {a[-1]: known[a[-1]]}
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
                )

    return run


def _row(docs: DataFrame) -> Column:
    """64-bit hash of a row's id and text, by which a text is found again; an id may have several texts."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Takes ``doc_id long, text`` (more columns are ignored) and returns ``doc_id, n_shingles, component_id, kept``, one
    row per input row. Null and empty texts and those of white space have no shingles and link with nothing; a text
    of fewer words than a shingle is one shingle. A null doc_id takes part in nothing: its component_id is null and
    the row is kept. Rows that repeat a doc_id are each judged by their own text. An empty table gives an empty result.

    1. Documents with equal sets (128 bits over the whole set and its size) become one node, grouped with map-side
       combine and named by the hash of one of its rows; the smallest doc_id is looked up for whole components. 2. HyperMinHash registers are cut into bands. In each band bucket all members are paired with one
       only, the one that meets most others over all bands, and each document takes its two best pairs by estimate
       to the check on whole sets.
    3. With the components so far, every pair of different components that still shares a bucket is compared, so a
       bucket costs its members times those outside its main component, and no link between different texts is
       lost but by the banding itself. Buckets are dealt out in pairs of pieces of about PIECE members; registers
       are compared inside the task, and only pairs that are near by estimate are written and checked. 4. Components of all links.
    """
    return _judged(docs, words, percent).drop("row")


def _judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``near_duplicates`` with the ``_row`` of each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _row(docs).alias("row"), F.col("text").cast("string").alias("text")
    )
    sketches = scratch.table(
        text.mapInArrow(
            _sketches(words), "doc_id long, row long, n_shingles long, set_a long, set_b long, registers binary"
        ),
        "sketches",
    )
    key = ["n_shingles", "set_a", "set_b"]
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.table(usable.groupBy(*key).agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
    nodes = scratch.table(
        usable.join(classes, key).where("row = node").select("node", "registers").dropDuplicates(["node", "registers"]),
        "nodes",
    )
    banded = nodes.mapInArrow(_explode_bands, "band long, node long").distinct()
    buckets = scratch.table(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = banded.join(buckets, "band")
    # how many others a node meets; the original of many edited copies meets more than any of the copies
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    members = scratch.table(members.select("band", "node").join(met, "node"), "members")
    hubs = members.groupBy("band").agg(F.max(F.struct("met", "node")).alias("hub"))
    hubs = scratch.table(hubs.select("band", F.col("hub.node").alias("hub")), "hubs")

    def estimated(pairs: DataFrame) -> DataFrame:
        left = nodes.select(F.col("node").alias("a"), F.col("registers").alias("ra"))
        right = nodes.select(F.col("node").alias("b"), F.col("registers").alias("rb"))
        near = pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb")
        near = near.mapInArrow(_estimates, "a long, b long, estimate double")
        return near.where(F.col("estimate") >= percent / 100 - MARGIN)

    def verified(pairs: DataFrame) -> DataFrame:
        left = text.select(F.col("row").alias("a"), F.col("text").alias("ta"))
        right = text.select(F.col("row").alias("b"), F.col("text").alias("tb"))
        both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
        return both.mapInArrow(_verified(words, percent), "a long, b long, linked boolean")

    star = members.join(hubs, "band").where("node <> hub")
    star = star.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    best = Window.partitionBy("b").orderBy(F.desc("estimate"), "a")
    first = estimated(star).withColumn("nth", F.row_number().over(best)).where("nth <= 2")
    tried = scratch.table(verified(scratch.table(first.select("a", "b"), "star")), "tried")
    links = tried.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    joined = connected_components(links, scratch).withColumnRenamed("id", "node")

    placed = scratch.table(
        members.join(joined, "node", "left").select("band", "node", F.coalesce("component", "node").alias("part")),
        "placed",
    )
    parts = placed.groupBy("band", "part").agg(F.count("*").alias("n"))
    main = parts.groupBy("band").agg(
        F.max(F.struct("n", "part")).alias("most"), F.count("*").alias("parts")
    )
    mixed = scratch.table(main.where("parts > 1").select("band", F.col("most.part").alias("main")), "mixed")
    # outsiders meet each other (kind 0) and the main component (kind 1), piece by piece
    within = placed.join(mixed, "band").withColumn("outside", F.col("part") != F.col("main"))
    counts = within.groupBy("band").agg(
        F.ceil(F.count_if("outside") / PIECE).cast("int").alias("outer"),
        F.ceil(F.count_if(~F.col("outside")) / PIECE).cast("int").alias("inner"),
    )
    within = within.join(counts, "band").withColumn(
        "own", F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("outer")).otherwise(F.col("inner"))).cast("int")
    )

    def meeting(kind: int, p: Column, q: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), side.cast("int").alias("side"))

    outer = F.sequence(F.lit(0), F.col("outer") - 1)
    inner = F.sequence(F.lit(0), F.col("inner") - 1)
    own = F.col("own")
    meetings = F.when(
        F.col("outside"),
        F.concat(
            F.transform(outer, lambda k: meeting(0, F.least(own, k), F.greatest(own, k), own > k)),
            F.transform(inner, lambda k: meeting(1, own, k, F.lit(0))),
        ),
    ).otherwise(F.transform(outer, lambda k: meeting(1, k, own, F.lit(1))))
    keys = ["band", "kind", "p", "q"]
    dealt = within.select("band", "node", "part", F.inline(meetings))
    dealt = dealt.join(nodes, "node").select(*keys, "side", "node", "part", "registers")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    rest = scratch.table(dealt.mapInArrow(_compare(percent / 100 - MARGIN), "a long, b long"), "rest")
    rest = rest.distinct().join(
        tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"
    )
    later = scratch.table(verified(rest), "later")
    more = later.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    component = connected_components(links.union(more), scratch)

    found = scratch.table(
        classes.join(component, classes.node == component.id, "left").select(
            *key, "least", F.coalesce("component", "node").alias("part")
        ),
        "found",
    )
    smallest = found.groupBy("part").agg(F.min("least").alias("class_component"))
    named = found.join(smallest, "part").select(*key, "class_component")
    out = sketches.join(named, key, "left")
    out = out.select(
        "row",
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), None)
        .otherwise(F.coalesce("class_component", "doc_id"))
        .cast("long")
        .alias("component_id"),
    ).withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    return scratch.finish(out)


def distinct_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all its columns: the one whose doc_id names the component.

    Of an id that is used for several texts, each text goes or stays by itself; texts that are near to each other under
    the id that names their component all stay.
    """
    scratch = Scratch(docs.sparkSession, "distinct-near")
    gone = _judged(docs, words, percent).where("not kept").select("row", "doc_id").distinct()
    mine, id_ = free_names(docs, "_row", "_id")
    keyed = docs.withColumns({mine: _row(docs), id_: docs["doc_id"].cast("long")})
    rest = without(
        keyed, scratch.table(gone, "gone"), lambda g: (keyed[mine] == g["row"]) & (keyed[id_] == g["doc_id"])
    )
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])
