"""Near-duplicate vectors by spherical-cap filters over a structured random product code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeta.llm.common import Scratch, groups_of
from pubmeta.llm.components import connected_components

#: Codes, each over another split of the components into two blocks, and directions of a block; all pairs of a
#: code's directions are its filters (36,864 over all codes). One large code would do for most vectors, but a
#: vector whose halves both score low has no filter in it; independent splits even that out.
CODES = 16
DIRECTIONS = 48
#: Share of the sphere inside a filter's cap. A vector passes about 32 filters; in a trial of 1,500 pairs at
#: cosine 0.93 half of this share missed 0.6 % and 1.3 times it missed none.
CAP = 9e-4
#: A vector that passes fewer filters is listed under so many of its nearest ones instead.
LEAST_FILTERS = 8
LEAST_DIM = 64
#: Members of a bucket that are compared at once; larger buckets are cut into pairs of such pieces.
PIECE = 512


@lru_cache(maxsize=16)
def product_codes(dim: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], float]:
    """A random rotation; per code the order of components and the unit directions of both blocks; the threshold of a
    cap of share CAP.

    The rotation spreads vectors whose weight lies in few components over all, so that both blocks of a code see their
    share of them. It also takes short vectors into a space of LEAST_DIM components, where there are enough directions.
    """
    rng = np.random.default_rng(dim)
    dim, short = max(dim, LEAST_DIM), dim
    half = (dim + 1) // 2
    turn = np.linalg.qr(rng.standard_normal((dim, short)))[0]
    codes = []
    for _ in range(CODES):
        blocks = [rng.standard_normal((DIRECTIONS, n)) for n in (half, dim - half)]
        blocks = [b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300) for b in blocks]
        codes.append((rng.permutation(dim), *blocks))
    first = rng.standard_normal(200_000)
    rest = rng.chisquare(dim - 1, 200_000)
    return turn, codes, float(np.quantile(first / np.sqrt(first**2 + rest), 1 - CAP))


def decode(unit: np.ndarray) -> np.ndarray:
    """All filters whose direction has an inner product of at least the threshold with the unit vector.

    Blocks are scored on their own. Sorting the second block's scores gives, for each direction of the first, the
    run of partners that still exceed the threshold, so only filters that pass are listed. A vector that passes fewer
    than LEAST_FILTERS gets that many nearest ones.
    """
    turn, codes, threshold = product_codes(len(unit))
    turned = turn @ unit
    found, scores = [], []
    for k, (places, left, right) in enumerate(codes):
        v = turned[places]
        one, two = left @ v[: left.shape[1]], right @ v[left.shape[1] :]
        scores.append((one, two))
        order = np.argsort(-two)
        runs = np.searchsorted(-two[order], one - np.sqrt(2) * threshold, "right")
        first = np.repeat(np.arange(DIRECTIONS), runs)
        within = np.arange(len(first)) - np.repeat(np.cumsum(runs) - runs, runs)
        found.append((k * DIRECTIONS + first) * DIRECTIONS + order[within])
    passed = np.concatenate(found)
    if len(passed) < LEAST_FILTERS:
        every = np.concatenate([(one[:, None] + two[None, :]).ravel() for one, two in scores])
        passed = np.argsort(-every, kind="stable")[:LEAST_FILTERS]
    return np.sort(passed).astype(np.int32)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def _unpacked(data: bytes, dim: int) -> np.ndarray:
    return _unit(np.frombuffer(data, np.float32 if len(data) == 4 * dim else np.float64).astype(np.float64))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, lists = [], []
        for row in batch.column("embedding").to_pylist():
            raw = np.array(row, np.float64)
            small = raw.astype(np.float32)
            # single precision is sent where that is what the vector has
            vectors.append((small if (small == raw).all() else raw).tobytes())
            lists.append(decode(_unit(raw)).tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("label"),
                batch.column("dim"),
                batch.column("node"),
                batch.column("weight"),
                pa.array(vectors, pa.binary()),
                pa.array(lists, pa.binary()),
            ],
            names=["label", "dim", "node", "weight", "vec", "filters"],
        )


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each filter of a vector."""
    for batch in batches:
        lists = [np.frombuffer(x, np.int32) for x in batch.column("filters").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(at) for c in ("label", "dim", "node")), pa.array(flat, pa.int32())],
            names=["label", "dim", "node", "filter"],
        )


def _earlier(lists: list[np.ndarray], before: int) -> tuple[np.ndarray, np.ndarray]:
    cut = [x[: np.searchsorted(x, before)] for x in lists]
    return np.repeat(np.arange(len(cut)), [len(x) for x in cut]), np.concatenate(cut)


def _share_earlier(left: list[np.ndarray], right: list[np.ndarray], before: int) -> np.ndarray:
    """Which pairs share a filter below ``before``, where they have been counted."""
    (li, lv), (ri, rv) = _earlier(left, before), _earlier(right, before)
    both = np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)), bool)
    for i in range(0, len(both), 2048):
        columns = both[i : i + 2048]
        marks = []
        for rows, values, n in ((li, lv, len(left)), (ri, rv, len(right))):
            at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
            hit = columns[at] == values
            m = np.zeros((n, len(columns)), np.float32)
            m[rows[hit], at[hit]] = 1
            marks.append(m)
        out |= marks[0] @ marks[1].T > 0
    return out


def _compare(table: pa.Table, cosine: float) -> pa.Table | None:
    """Links first met in this bucket: per node the weight of its partners, and an edge to a partner's root."""
    rows = table.to_pydict()
    filter_id, same = rows["filter"][0], rows["pa"][0] == rows["pb"][0]
    side = np.array(rows["side"])
    node = np.array(rows["node"], np.int64)
    weight = np.array(rows["weight"], np.int64)
    vec = np.vstack([_unpacked(v, d) for v, d in zip(rows["vec"], rows["dim"], strict=True)])
    lists = [np.frombuffer(f, np.int32) for f in rows["filters"]]
    a = np.arange(len(node)) if same else np.flatnonzero(side == 0)
    b = np.arange(len(node)) if same else np.flatnonzero(side == 1)
    if not len(a) or not len(b):
        return None
    linked = vec[a] @ vec[b].T >= cosine
    if same:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return None
    linked &= ~_share_earlier([lists[i] for i in a], [lists[i] for i in b], filter_id)
    total = np.zeros(len(node), np.int64)
    total[a] += linked @ weight[b]
    if not same:
        total[b] += linked.T @ weight[a]
    root = node.copy()
    while True:
        low = np.where(linked, root[b][None, :], root[a][:, None]).min(axis=1)
        root[a] = np.minimum(root[a], low)
        if not same:
            up = np.where(linked, root[a][:, None], root[b][None, :]).min(axis=0)
            changed = (up < root[b]).any()
            root[b] = np.minimum(root[b], up)
        else:
            changed = (np.where(linked, root[None, :], root[:, None]).min(axis=1) < root).any()
        if not changed:
            break
    found = total > 0
    return pa.table({"node": node[found], "links": total[found], "root": root[found]})


def _links(cosine: float):
    """Sorted rows of buckets in, ``node, links, root`` out."""
    keys = ("label", "dim", "filter", "pa", "pb")
    return lambda batches: groups_of(batches, keys, lambda table: _compare(table, cosine))


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Links of vectors with equal labels whose cosine is at least ``cosine``.

    Takes ``vec_id long, embedding array of float or double, label integer`` (more columns are ignored) and returns
    ``vec_id, n_links, component_id, kept``, one row per input row. Vectors that are null, empty, zero or hold a null
    or non-finite component, and rows without a label, link with nothing. Only vectors of as many components are
    compared. A null vec_id takes part in nothing: its component_id is null and the row is kept. Rows that repeat
    a vec_id count as vectors of their own in n_links. An empty table gives an empty result.

    Equal vectors are one node with a weight, made with map-side combine. Every node is listed under all filters whose
    direction lies in its cap; nodes that share a filter meet in a bucket, and cosines are taken in double precision. A
    bucket is dealt out in pairs of pieces of at most PIECE nodes, so no bucket is one task. A link is counted in
    the first bucket that both ends share; pairs are never written, only each node's sum of partners and one edge.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "caps")
    base = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("long").alias("label"),
    ).withColumn("dim", F.size("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (
        F.col("embedding").isNotNull()
        & F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & ~bad
        & F.exists("embedding", lambda x: x != 0)
    )
    usable = base.where(F.coalesce(good, F.lit(False)))
    # a number of its own for each class, as two vectors may share a vec_id; it is fixed by being written
    classes = scratch.table(
        usable.groupBy("label", "dim", "embedding")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    nodes = scratch.table(
        classes.repartition("node").mapInArrow(
            _units, "label long, dim int, node long, weight long, vec binary, filters binary"
        ),
        "nodes",
    )
    passed = nodes.mapInArrow(_passed, "label long, dim int, node long, filter int")
    bucket = ["label", "dim", "filter"]
    sizes = scratch.table(
        passed.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn(
            "pieces", F.ceil(F.col("n") / PIECE).cast("int")
        ),
        "sizes",
    )
    piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    placed = (
        passed.join(sizes, bucket)
        .withColumn("own", piece)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select(
            *bucket,
            F.least("own", "other").alias("pa"),
            F.greatest("own", "other").alias("pb"),
            F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
            "node",
        )
    )
    payload = nodes.select("node", "weight", "vec", "filters")
    keys = [*bucket, "pa", "pb"]
    dealt = placed.join(payload, "node").select(*keys, "side", "node", "weight", "vec", "filters")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    links = scratch.table(dealt.mapInArrow(_links(cosine), "node long, links long, root long"), "links")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    edges = links.where("node <> root").select(F.col("root").alias("src"), F.col("node").alias("dst"))
    component = connected_components(edges, scratch)
    found = scratch.table(
        classes.join(counted, "node", "left")
        .join(component, classes.node == component.id, "left")
        .select(
            "label",
            "dim",
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            "least",
            F.coalesce("component", "node").alias("part"),
        ),
        "found",
    )
    smallest = found.groupBy("part").agg(F.min("least").alias("component_id"))
    known = found.join(smallest, "part").drop("part", "least")
    out = (
        base.withColumn("good", F.coalesce(good, F.lit(False)))
        .withColumn("label", F.when(F.col("good"), F.col("label")))
        .join(known, ["label", "dim", "embedding"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
    return scratch.finish(out)
