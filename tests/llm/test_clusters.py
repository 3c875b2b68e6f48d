"""Clusters by pivots against plain rounds over all distances."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubmeta.llm import clusters


def plain(rows, dim=64, k=40, rounds=5, seed=2):
    kept = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, g in groups.items():
            centroids[j] = [sum(x) // len(g) for x in zip(*g)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(r[2] for r in found)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, sum(r[2] for r in found if r[1] == c), total, sha[c]) for i, c, d in found)


def _got(df):
    return sorted(tuple(r)[:6] for r in df.collect())


DDL = "vec_id long, embedding array<double>"


def test_against_all_distances(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 6))
    rows = [(i, (centres[i % 12] + rng.standard_normal(6) * 0.1).tolist()) for i in range(400)]
    rows += [(900, [1e-9] * 6), (901, [0.0] * 6), (902, [0.0] * 6), (3, rows[3][1])]
    rows += [(903, None), (904, []), (905, [1.0] * 5), (906, [1.0] * 5 + [None]), (907, [math.nan] * 6), (908, [math.inf] + [0.0] * 5)]
    df = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("x") for c in ("cluster", "distance", "v", "pivots")})
    got = clusters.clustered_vectors(df.repartition(3), dim=6, clusters=9, rounds=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"]
    assert _got(got) == plain(rows, dim=6, k=9, rounds=4)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.5] * 4), (2, [0.25] * 4), (3, [0.5] * 4)]
    assert _got(clusters.clustered_vectors(spark.createDataFrame(rows, DDL), dim=4)) == plain(rows, dim=4)
    assert clusters.clustered_vectors(spark.createDataFrame([], DDL)).count() == 0
    same = [(i, [0.1] * 4) for i in range(50)]
    assert _got(clusters.clustered_vectors(spark.createDataFrame(same, DDL), dim=4)) == plain(same, dim=4)


def test_null_ids_are_kept(spark):
    rows = [(None, [0.5] * 4), (2, [0.25] * 4)]
    got = clusters.clustered_vectors(spark.createDataFrame(rows, DDL), dim=4, clusters=1).collect()
    assert {r["vec_id"] for r in got} == {None, 2} and all(r["cluster"] == 0 for r in got)


@pytest.mark.parametrize("scale", [1, 1000, 1 << 26])
def test_bounds_are_below_distances_and_spare_most_of_them(scale):
    rng = np.random.default_rng(scale)
    centres = rng.integers(-scale, scale + 1, (20, 16))
    rows = centres[rng.integers(20, size=2000)] + rng.integers(-max(scale // 50, 1), max(scale // 50, 1) + 1, (2000, 16))
    bounds = clusters.Bounds(centres[:8])
    cached = bounds.cached(rows)
    low = bounds.lower(cached, bounds.cached(centres))
    exact = np.array([[int(((r - c).astype(object) ** 2).sum()) for c in centres] for r in rows[:200]], dtype=object)
    assert all(low[i, j] <= exact[i, j] for i in range(200) for j in range(20))
    checked: list[int] = []
    nearest, best = clusters.assign(rows, cached, centres, bounds, checked)
    assert [min((d, j) for j, d in enumerate(e)) for e in exact.tolist()] == list(zip(best[:200].tolist(), nearest[:200].tolist()))
    if scale > 1:
        assert checked[0] < 0.5 * 2000 * 20
