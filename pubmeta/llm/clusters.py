"""Lloyd's rounds on integer vectors, with distances ruled out by Ptolemy's inequality over fixed pivot pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubmeta.llm.common import Scratch

#: Components are taken in steps of 1/STEPS; those beyond LARGEST in size have no squared distance that fits a long.
STEPS = 256
LARGEST = float(1 << 19)
#: Pivots whose distances are cached with each vector, and pairs of them that give bounds.
PIVOTS = 8
PAIRS = 12
#: Far more than the rounding errors of a bound, which is a few operations on doubles.
SLACK = 2.0**-45


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """Lower bounds of distances to centroids from distances to pivots.

    For any four points, d(o,c) d(p,s) >= |d(o,p) d(c,s) - d(o,s) d(c,p)|. The pivots stay the same in all rounds, so a
    vector's distances to them are cached; those of the centroids are taken anew, k times PIVOTS numbers.
    """

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        apart = [(float(np.sqrt(squared(pivots[i : i + 1], pivots[j : j + 1])[0])), i, j) for i, j in combinations(range(len(pivots)), 2)]
        self.pairs = sorted((p for p in apart if p[0] > 0), reverse=True)[:PAIRS]

    def cached(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.pivots)))
        for i, p in enumerate(self.pivots):
            out[:, i] = np.sqrt(squared(rows, p[None, :]).astype(np.float64))
        return out

    def lower(self, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Squared bounds from cached distances of vectors and centroids, rounded down."""
        best = np.zeros((len(rows), len(centroids)))
        for apart, i, j in self.pairs:
            one = rows[:, i, None] * centroids[None, :, j]
            two = rows[:, j, None] * centroids[None, :, i]
            np.maximum(best, (np.abs(one - two) - (one + two) * SLACK) / apart, out=best)
        return best * best * (1 - SLACK)


def assign(
    rows: np.ndarray, cached: np.ndarray, centroids: np.ndarray, bounds: Bounds, checked: list[int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (the smaller number on a tie) and its exact squared distance.

    The centroid with the least bound gives a first distance. All whose bound does not exceed the best so far are
    measured, ties included. ``checked`` collects how many distances were measured.
    """
    low = bounds.lower(cached, bounds.cached(centroids))
    nearest = low.argmin(axis=1)
    best = squared(rows, centroids[nearest])
    seed = nearest.copy()
    measured = len(rows)
    for c in range(len(centroids)):
        open_ = np.flatnonzero((low[:, c] <= best.astype(np.float64) * (1 + SLACK)) & (seed != c))
        if not len(open_):
            continue
        measured += len(open_)
        d = squared(rows[open_], centroids[c][None, :])
        better = (d < best[open_]) | ((d == best[open_]) & (c < nearest[open_]))
        best[open_[better]], nearest[open_[better]] = d[better], c
    if checked is not None:
        checked.append(measured)
    return nearest, best


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _caching(bounds: Bounds, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bounds.cached(_matrix(batch.column("v"), dim, np.int64))
            width = found.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * width, pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], names=["vec_id", "v", "pivots"])

    return run


def _summing(bounds: Bounds, centroids: np.ndarray):
    """Per task and cluster the sum of each component, and the number of vectors as component -1."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            rows = _matrix(batch.column("v"), dim, np.int64)
            nearest, _ = assign(rows, _matrix(batch.column("pivots"), len(bounds.pivots), np.float64), centroids, bounds)
            np.add.at(sums, nearest, rows)
            counts += np.bincount(nearest, minlength=k)
        used = np.flatnonzero(counts)
        total = np.column_stack([counts[used], sums[used]]).ravel()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, dim + 1), pa.int32()),
                pa.array(np.tile(np.arange(-1, dim), len(used)), pa.int32()),
                pa.array(total, pa.int64()),
            ],
            names=["cluster", "component", "total"],
        )

    return run


def _assigning(bounds: Bounds, centroids: np.ndarray):
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("v"), dim, np.int64)
            nearest, best = assign(rows, _matrix(batch.column("pivots"), len(bounds.pivots), np.float64), centroids, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(nearest, pa.int32()), pa.array(best, pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    return run


def _moved(centroids: np.ndarray, totals: list) -> np.ndarray:
    """Floored means of the clusters that have vectors; the others stay."""
    out = centroids.copy()
    counts = {r["cluster"]: r["total"] for r in totals if r["component"] < 0}
    for r in totals:
        if r["component"] >= 0:
            out[r["cluster"], r["component"]] = r["total"] // counts[r["cluster"]]
    return out


def clustered_vectors(
    vectors: DataFrame, dim: int = 64, clusters: int = 40, rounds: int = 5, seed: int = 2
) -> DataFrame:
    """Clusters of the vectors after ``rounds`` rounds of assigning and averaging.

    Takes ``vec_id long, embedding array of float or double`` (more columns are ignored) and returns ``vec_id, cluster,
    distance, cluster_inertia, inertia, centroid_sha256, centroid``, one row per kept vector. Kept are vectors of
    exactly ``dim`` components, none null, non-finite or beyond LARGEST in size. They are compared as whole numbers of
    1/STEPS, so every sum and distance is exact. Rows that repeat a vec_id are vectors of their own; a null vec_id is
    kept, and comes last where ids choose the first centroids. Fewer vectors than ``clusters`` give as many centroids.
    Inertias beyond a long are null. An empty table gives an empty result.

    A round is one pass over the stored vectors with their cached pivot distances: tasks add up their vectors per
    cluster, and ``clusters x dim`` sums reach the driver. Nothing is shuffled but those sums, no cluster is gathered
    anywhere, and no assignment is kept between rounds, so a lost executor costs only its tasks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    x = F.col("embedding").cast("array<double>")
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).where(fits)
    kept = kept.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * STEPS).cast("long")).alias("v")
    )
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(order.asc_nulls_last(), "v").limit(clusters).collect()
    ddl = "vec_id long, cluster int, distance long"
    if not first:
        none = f"{ddl}, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
        return spark.createDataFrame([], none)
    centroids = np.array([r["v"] for r in first], np.int64)
    bounds = Bounds(np.unique(centroids[: 2 * PIVOTS], axis=0)[:PIVOTS])
    stored = scratch.table(kept.mapInArrow(_caching(bounds, dim), "vec_id long, v array<long>, pivots array<double>"), "kept")
    for _ in range(rounds):
        sums = stored.mapInArrow(_summing(bounds, centroids), "cluster int, component int, total long")
        centroids = _moved(centroids, sums.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect())
    assigned = scratch.table(stored.mapInArrow(_assigning(bounds, centroids), ddl), "assigned")
    inertia = assigned.groupBy("cluster").agg(F.try_sum(F.col("distance")).alias("cluster_inertia"))
    inertia = {r["cluster"]: r["cluster_inertia"] for r in inertia.collect()}
    total = None if None in inertia.values() else sum(inertia.values())
    numbers = [
        (c, inertia[c], total, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), v)
        for c, v in enumerate(centroids.tolist())
        if c in inertia
    ]
    known = spark.createDataFrame(
        numbers, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    )
    out = assigned.join(F.broadcast(known), "cluster")  # at most ``clusters`` rows
    return scratch.finish(
        out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
    )


def oracle(clusters: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64) -> str:
    """The same by all distances, round by round, in SQL."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id,
  list_transform(embedding, lambda x: CAST(floor({STEPS} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v FROM (
  SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {clusters}))""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT n, min(struct_pack(d := d, cluster := cluster)) AS best FROM (
  SELECT n, cluster, CAST(list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM kept, c{i}) GROUP BY n)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} AS MATERIALIZED (SELECT cluster, list(mean ORDER BY pos) AS v FROM (
  SELECT cluster, pos, CAST((s - ((s % c) + c) % c) // c AS BIGINT) AS mean FROM (
    SELECT a{i}.best.cluster AS cluster, pos, sum(v[pos]) AS s, count(*) AS c
    FROM a{i} JOIN kept ON a{i}.n = kept.n, generate_series(1, {dim}) t(pos) GROUP BY ALL)) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON c{i}.cluster = m{i}.cluster)"""
            )
    last = f"a{rounds}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, {last}.best.cluster AS cluster, {last}.best.d AS distance,
  CAST(sum({last}.best.d) OVER (PARTITION BY {last}.best.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum({last}.best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM {last} JOIN kept ON {last}.n = kept.n JOIN c{rounds} ON c{rounds}.cluster = {last}.best.cluster"""
