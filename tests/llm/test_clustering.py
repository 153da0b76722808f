"""Exact k-means against a plain loop, and the Ptolemaic bound against true distances."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import clustering


def plain(rows, k=16, rounds=3):
    kept = [
        (i, [max(-(1 << 27), min(1 << 27, math.floor(max(-1e300, min(1e300, 64 * x))))) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(near(v)[1], []).append(v)
        at = [[sum(x) // len(by[n]) for x in zip(*by[n], strict=True)] if n in by else c for n, c in enumerate(at)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, d, n in found:
        inertia[n] = inertia.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, d, n in found), key=repr)


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, 64))
    return [(i, (centres[i % 5] + rng.normal(0, 0.1, 64)).tolist()) for i in range(n)]


ODD = [
    (900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.1] * 63 + [None]), (905, [0.1] * 63 + [float("nan")]),
    (906, [0.1] * 63 + [float("inf")]), (907, [0.0] * 64), (908, [0.0] * 64), (908, [0.0] * 64), (None, [0.25] * 64), (909, [-0.01] * 64),
]


@pytest.mark.parametrize("rows", [vectors(1, 300) + ODD, vectors(2, 7), [(i, [1.0] * 64) for i in range(40)], ODD], ids=["mixed", "few", "equal", "odd"])
def test_rows_against_plain(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit("x"), "cluster": F.lit(-1), "to_pivots": F.lit(0)})
    got = sorted((tuple(r) for r in clustering.summary(frame).collect()), key=repr)
    assert got == plain(rows)


def test_large_components(spark):
    rows = [(i, [1e30 if i % 2 else -1e30] * 64) for i in range(4)] + [(9, [3.0e5] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:3] for r in clustering.summary(frame, centroids=2).collect())
    assert got == [tuple(r)[:3] for r in plain(rows, 2)]


def test_nothing_kept(spark):
    frame = spark.createDataFrame(ODD[:7], "vec_id long, embedding array<double>")
    assert clustering.summary(frame).collect() == []
    assert clustering.summary(frame.limit(0)).columns[:3] == ["vec_id", "cluster", "distance"]


def test_bound_is_never_over_the_distance():
    rng = np.random.default_rng(3)
    for size in (3, 50, 1 << 26):
        points = rng.integers(-size, size + 1, (200, 64))
        points[100:] = points[:100] + rng.integers(-1, 2, (100, 64))  # close pairs
        pivots = clustering.Pivots(points[:16])
        cached = pivots.distances(points)
        for c in points[::7]:
            below = pivots.below(cached, pivots.distances(c[None])[0])
            assert (below <= clustering.squared(points, c) * (1 + clustering.EPS)).all()
        assert below.max() > 0


def test_bounds_spare_distances():
    rng = np.random.default_rng(4)
    centres = rng.integers(-60, 60, (16, 64))
    points = np.repeat(centres, 100, axis=0) + rng.integers(-3, 4, (1600, 64))
    pivots = clustering.Pivots(points[::100])
    number, best, computed = clustering.nearest(points, pivots.distances(points), centres, pivots, np.zeros(1600))
    assert (number == np.repeat(np.arange(16), 100)).all() and (best == clustering.squared(points, centres[number])).all()
    assert computed < 0.5 * 1600 * 16


def test_without_pairs_all_are_checked():
    points = np.ones((3, 64), np.int64)
    pivots = clustering.Pivots(points[:1])
    number, best, computed = clustering.nearest(points, pivots.distances(points), points, pivots, np.full(3, 2))
    assert number.tolist() == [0, 0, 0] and best.tolist() == [0, 0, 0] and computed == 9
