"""Centroid clustering of integer vectors: exact k-means rounds that skip centroids by Ptolemaic lower bounds."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.storage import stored

COMPONENTS = 64
SCALE = 64  # a component x becomes floor(SCALE * x)
CENTROIDS = 16
ROUNDS = 3
SEED = 1
PARTNERS = 2  # pivots that each pivot is paired with
TOP = 1 << 27  # larger components saturate here, so that 64 squared differences fit a long
ROWS = 4096  # vectors that are compared at once
EPS = 2.0**-50  # well over the rounding of the few operations behind a bound


def whole_vectors(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors of `table` (vec_id, embedding) with exactly `components` finite components, as integers."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    kept = table.where((F.size("embedding") == components) & finite).select("vec_id", x.alias("x"))
    clipped = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(TOP))), F.lit(float(-TOP)))).cast("int")
    return kept.select("vec_id", F.transform("x", clipped).alias("v"))


def first_by_hash(vectors: DataFrame, n: int, seed: int) -> np.ndarray:
    """The n vectors with the smallest SHA-256 of seed and id, in that order; ties by components, null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", digest.alias("digest")).orderBy(F.asc_nulls_last("digest"), "v").limit(n).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), COMPONENTS)


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows to a point (or to a row each)."""
    apart = vectors - point
    return np.einsum("ij,ij->i", apart, apart)


@dataclass
class Pivots:
    """Fixed pivots and the pairs of different ones that bounds are taken over."""

    points: np.ndarray

    def __post_init__(self):
        n = len(self.points)
        self.apart = np.sqrt(np.array([squared(self.points, p) for p in self.points], np.float64).reshape(n, n))
        # each with those farthest from it: a point beside one pivot then has a bound close to its distance
        partners = ((i, int(j)) for i in range(n) for j in np.argsort(-self.apart[i], kind="stable")[:PARTNERS] if self.apart[i, j] > 0)
        self.pairs = sorted({(max(p), min(p)) for p in partners})

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([squared(vectors, p) for p in self.points], axis=1).astype(np.float64))

    def below(self, cached: np.ndarray, point: np.ndarray) -> np.ndarray:
        """A squared distance that no row's true one to a point is under, from the distances of both to the pivots.

        Ptolemy: d(x,c) d(p,q) >= |d(x,p) d(c,q) - d(x,q) d(c,p)|. What rounding may have added is taken off.
        """
        best = np.zeros(len(cached))
        for p, q in self.pairs:
            one, two = cached[:, p] * point[q], cached[:, q] * point[p]
            np.maximum(best, (np.abs(one - two) - EPS * (one + two)) / self.apart[p, q], out=best)
        return best * best * (1 - EPS)


def nearest(vectors: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: Pivots, guess: np.ndarray):
    """(number, exact squared distance) of each row's nearest centroid, the smaller number on ties, and how many distances were
    computed. `guess` is any centroid of each row: its distance is the first bound to beat."""
    number = guess.astype(np.int64)
    best = squared(vectors, centroids[number])
    computed = len(vectors)
    to_pivots = pivots.distances(centroids)
    for c in range(len(centroids)):
        left = np.flatnonzero((pivots.below(cached, to_pivots[c]) <= best * (1 + EPS)) & (guess != c))
        if not len(left):
            continue
        distance = squared(vectors[left], centroids[c])
        computed += len(left)
        better = (distance < best[left]) | ((distance == best[left]) & (c < number[left]))
        number[left[better]], best[left[better]] = c, distance[better]
    return number, best, computed


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _cache(pivots: Pivots):
    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                made = pivots.distances(_matrix(part.column("v"), np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(made), pa.list_(pa.float64()))], names=[*part.schema.names, "to_pivots"])

    return run


def _parts(batches, centroids, pivots):
    """(rows, vectors, number, distance, computed) of bounded slices of the batches."""
    for batch in batches:
        for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
            vectors, cached = _matrix(part.column("v"), np.int64), _matrix(part.column("to_pivots"), np.float64)
            # the first guess needs no exact distance: the centroid with the least bound
            bounds = np.stack([pivots.below(cached, d) for d in pivots.distances(centroids)], axis=1)
            yield part, vectors, *nearest(vectors, cached, centroids, pivots, bounds.argmin(axis=1))


def _sums(centroids: np.ndarray, pivots: Pivots):
    """One row a centroid and task: how many vectors are nearest to it, and their sum."""

    def run(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, vectors, number, _, _ in _parts(batches, centroids, pivots):
            count += np.bincount(number, minlength=len(centroids))
            by = np.argsort(number, kind="stable")
            here, begin = np.unique(number[by], return_index=True)
            total[here] += np.add.reduceat(vectors[by], begin, axis=0)
        here = np.flatnonzero(count)
        if len(here):
            columns = [pa.array(here, pa.int32()), pa.array(count[here]), pa.array(total[here].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "total"])

    return run


def _assigned(centroids: np.ndarray, pivots: Pivots):
    def run(batches):
        for part, _, number, distance, computed in _parts(batches, centroids, pivots):
            work = np.zeros(len(number), np.int64)
            work[:1] = computed
            columns = [part.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance), pa.array(work)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "computed"])

    return run


def moved(vectors: DataFrame, centroids: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Centroids after one round: floor of the exact mean of their vectors; those without vectors stay."""
    some = vectors.mapInArrow(_sums(centroids, pivots), "cluster int, n long, total array<long>")
    each = some.select("cluster", "n", F.posexplode("total").alias("at", "part"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(19,0)"))
    rows = each.groupBy("cluster", "at").agg(exact("n").alias("n"), exact("part").alias("part")).collect()  # centroids x components
    after = centroids.copy()
    for r in rows:
        after[r.cluster, r.at] = int(r.part) // int(r.n)
    return after


def cluster(table: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, computed) of every kept vector of `table` (vec_id, embedding), the final centroids).

    Vectors of another length, null ones and those with a null or non-finite component are left out; components
    saturate at +-2**27. Rows that repeat an id each count and come back. With fewer vectors than centroids each starts one;
    without any the result is empty. `computed` summed over rows is the number of exact distances of the last assignment.
    The first centroids are the pivots; distances to them are computed once and stored. The driver holds the centroids, the pivots and sums of centroids x components.
    """
    whole = whole_vectors(table)
    at = first_by_hash(whole, centroids, seed)
    fixed = Pivots(np.unique(at, axis=0))
    if not len(at):
        return whole.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "computed")]).limit(0), at
    vectors = stored(whole.mapInArrow(_cache(fixed), whole.withColumn("to_pivots", F.array(F.lit(0.0))).schema), "cluster-vectors")
    for _ in range(rounds):
        at = moved(vectors, at, fixed)
    schema = vectors.select("vec_id").schema.add("cluster", "integer").add("distance", "long").add("computed", "long")
    return stored(vectors.mapInArrow(_assigned(at, fixed), schema), "cluster-assigned"), at


def digest(point: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, point.tolist())).encode()).hexdigest()


def looked_up(values: dict[int, object], key: Column, kind: str) -> Column:
    """The value of a small dictionary (one entry a centroid) under `key`."""
    found = F.lit(None).cast(kind)
    for k, v in values.items():
        found = F.when(key == k, F.lit(v).cast(kind)).otherwise(found)
    return found


def summary(table: DataFrame, **options) -> DataFrame:
    """Clusters with the sums of their squared distances, of all of them, and a digest of each final centroid."""
    rows, at = cluster(table, **options)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()  # one row a centroid
    by = {r.cluster: int(r.s) for r in sums}
    return rows.select(
        "vec_id", "cluster", "distance", looked_up(by, F.col("cluster"), "long").alias("cluster_inertia"),
        F.lit(sum(by.values())).cast("long").alias("inertia"),
        looked_up({i: digest(p) for i, p in enumerate(at)}, F.col("cluster"), "string").alias("centroid_sha256"),
    )
