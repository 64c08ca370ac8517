"""Centroid clustering of vectors of whole numbers, exact, with distance bounds that follow the centroids' drift."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import ship
from newsloom.session import new_folder, remove

EXACT = float(1 << 53)  # sums of whole numbers up to here are exact in a double
LARGEST = (1 << 63) - 1
LIMB = 40  # bits of a sum that travel in one long, so that sums of sums do not overflow
SLACK = 1e-9  # relative; far above the rounding of the bounds, far below what they decide

STATE = (
    "vec_id long, x array<double>, cluster int, upper double, lower double, "
    "totals array<struct<dim:int,limb:int,total:long>>"
)
TOTALS = pa.list_(pa.struct([("dim", pa.int32()), ("limb", pa.int32()), ("total", pa.int64())]))
Centroids = list[list[int]]


class Clustering(NamedTuple):
    assigned: DataFrame  # vec_id, cluster, distance
    centroids: Centroids


class Drift(NamedTuple):
    """What a round's moves can do to the distances of each cluster's vectors."""

    own: np.ndarray  # how far the own centroid went
    others: np.ndarray  # by how much some other centroid can have come nearer


def squared_distances(x: np.ndarray, centroids: Centroids) -> np.ndarray:
    """Exact squared distances, a row for each vector; whole numbers too large for doubles are Python's."""
    out = np.empty((len(x), len(centroids)), object)
    largest = np.abs(x).max(axis=1, initial=0)
    most = max((abs(v) for c in centroids for v in c), default=0)
    small = np.maximum(largest, float(most)) < math.sqrt(EXACT / (4 * max(1, x.shape[1])))
    c = np.array([[float(v) for v in row] for row in centroids])
    if small.any():
        fast = x[small]
        found = (fast**2).sum(axis=1)[:, None] - 2 * (fast @ c.T) + (c**2).sum(axis=1)[None, :]
        if small.all():
            return found.astype(np.int64)
        out[small] = found.astype(np.int64)
    for i in np.flatnonzero(~small):
        row = [int(v) for v in x[i]]
        out[i] = [sum((a - b) ** 2 for a, b in zip(row, centroid)) for centroid in centroids]
    return out


def _root(square: int) -> float:
    return math.sqrt(square) if square < 1 << 1000 else float(math.isqrt(square))


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.array([_root(s) for s in squares]) if squares.dtype == object else np.sqrt(squares.astype(float))


def scan(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid (ties: the smaller number), the distance to it and to the second nearest."""
    squares = squared_distances(x, centroids)
    nearest = squares.argmin(axis=1)
    own = squares[np.arange(len(x)), nearest]
    if len(centroids) > 1:
        rest = squares.copy()
        rest[np.arange(len(x)), nearest] = rest.max() + 1 if len(x) else 0
        second = _roots(rest.min(axis=1))
    else:
        second = np.full(len(x), np.inf)
    return nearest.astype(np.int32), _roots(own), second


def drift(old: Centroids, new: Centroids, radius: list[float]) -> Drift:
    """How far each centroid went, and how much nearer some other one can be to a vector of each cluster.

    A centroid that goes from ``a`` to ``b`` comes nearer to ``x`` by ``|x-a| - |x-b| = 2 (x-m).(b-a) / (|x-a| + |x-b|)``
    with ``m`` their middle, and ``|x-a| + |x-b| >= 2 |x-m|``: by ``|b-a|`` times the cosine of the angle at ``m`` between
    the move and ``x``, at most. All vectors of a cluster lie in a sphere about its old centroid; in the plane through
    ``m``, the move and that centre, the sphere is seen from ``m`` under an angle known from its radius, and the point of
    it nearest in direction to the move gives the bound. A centroid that moves across, or away, costs little or nothing,
    where the plain bound is the whole length of the move.
    """
    k = len(old)
    went = [_root(sum((b - a) ** 2 for a, b in zip(p, q))) for p, q in zip(old, new)]
    others = [0.0] * k
    for a in range(k):
        for j in range(k):
            if j == a or not went[j] or went[j] <= others[a]:
                continue
            move = [q - p for p, q in zip(old[j], new[j])]
            from_middle = [2 * c - p - q for c, p, q in zip(old[a], old[j], new[j])]
            far = _root(sum(v * v for v in from_middle)) / 2
            seen = radius[a] * (1 + SLACK)
            share = 1.0
            if far > seen:
                cos = sum(u / went[j] * (v / (2 * far)) for u, v in zip(move, from_middle))
                cos = max(-1.0, min(1.0, cos))
                sin_of_sphere = seen / far
                cos_of_sphere = math.sqrt(1 - sin_of_sphere**2)
                if cos < cos_of_sphere:
                    share = max(0.0, cos * cos_of_sphere + math.sqrt(1 - cos * cos) * sin_of_sphere)
            others[a] = max(others[a], min(1.0, share + 1e-7) * went[j])
    return Drift(np.array(went), np.array(others))


def follow(
    x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids, moved: Drift
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters and bounds after a move, and how many vectors had to be scanned.

    Bounds are loosened; where the own centroid is then surely the nearest nothing is computed, else its exact distance
    is, and what is still in doubt meets all centroids.
    """
    upper = (upper + moved.own[cluster]) * (1 + 1e-12)
    loosened = moved.others[cluster]
    lower = lower - loosened - 1e-12 * np.where(np.isfinite(lower), lower + loosened, 0)
    doubt = ~(upper * (1 + SLACK) < lower)
    for c in np.unique(cluster[doubt]):
        rows = np.flatnonzero(doubt & (cluster == c))
        upper[rows] = _roots(squared_distances(x[rows], [centroids[c]])[:, 0])
    doubt &= ~(upper * (1 + SLACK) < lower)
    if doubt.any():
        cluster = cluster.copy()
        cluster[doubt], upper[doubt], lower[doubt] = scan(x[doubt], centroids)
    return cluster, upper, lower, int(doubt.sum())


class _Totals:
    """Signed changes of the clusters' sums and sizes, and the radii, in one task."""

    def __init__(self, k: int, width: int) -> None:
        self.sums = [[0] * (width + 1) for _ in range(k)]  # the last one counts
        self.radius = [0.0] * k

    def add(self, x: np.ndarray, cluster: np.ndarray, sign: int) -> None:
        for c in np.unique(cluster):
            rows = x[cluster == c]
            if float(np.abs(rows).max(initial=0)) * len(rows) < EXACT:
                found = [int(v) for v in rows.sum(axis=0)]
            else:
                found = [sum(int(v) for v in column) for column in rows.T]
            own = self.sums[c]
            for d, v in enumerate([*found, len(rows)]):
                own[d] += sign * v

    def widen(self, cluster: np.ndarray, upper: np.ndarray) -> None:
        for c in np.unique(cluster):
            self.radius[c] = max(self.radius[c], float(upper[cluster == c].max()))

    def rows(self) -> pa.RecordBatch:
        totals = []
        for own in self.sums:
            totals.append([
                {"dim": d, "limb": i, "total": part} for d, v in enumerate(own) for i, part in enumerate(limbs(v))
            ])
        k, none = len(totals), [None] * len(totals)
        return pa.RecordBatch.from_arrays(
            [pa.array(none, pa.int64()), pa.array(none, pa.list_(pa.float64())), pa.array(range(k), pa.int32()),
             pa.array(self.radius, pa.float64()), pa.array(none, pa.float64()), pa.array(totals, TOTALS)],
            [f.split()[0] for f in ("vec_id", "x", "cluster", "upper", "lower", "totals")],
        )


def limbs(v: int) -> list[int]:
    """A whole number in pieces of ``LIMB`` bits that carry its sign; none for zero."""
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v:
        out.append(sign * (v & ((1 << LIMB) - 1)))
        v >>= LIMB
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _assign(centroids: Centroids, moved: Drift | None, width: int, scale: float):
    """One round over the rows; the last rows of a task tell how its sums, sizes and radii have changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = _Totals(len(centroids), width)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            if moved is None:
                x = np.floor(x * scale)
                cluster, upper, lower = scan(x, centroids)
                totals.add(x, cluster, 1)
            else:
                before = batch.column("cluster").to_numpy()
                cluster, upper, lower, _ = follow(
                    x, before, batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), centroids, moved
                )
                changed = cluster != before
                totals.add(x[changed], before[changed], -1)
                totals.add(x[changed], cluster[changed], 1)
            totals.widen(cluster, upper)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, x.size + 1, width), pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), lists, pa.array(cluster), pa.array(upper), pa.array(lower),
                 pa.nulls(len(x), TOTALS)],
                ["vec_id", "x", "cluster", "upper", "lower", "totals"],
            )
        yield totals.rows()

    return run


def _changes(state: DataFrame, sums: Centroids) -> list[float]:
    """Adds what the tasks tell to ``sums`` and returns the clusters' radii."""
    told = state.filter("totals IS NOT NULL").select("cluster", "upper", "totals")
    found = (
        told.select("cluster", F.explode("totals").alias("t")).groupBy("cluster", "t.dim", "t.limb")
        .agg(F.sum("t.total").alias("total")).collect()
    )
    for row in found:
        sums[row.cluster][row.dim] += row.total << (LIMB * row.limb)
    radius = [0.0] * len(sums)
    for row in told.groupBy("cluster").agg(F.max("upper").alias("upper")).collect():
        radius[row.cluster] = row.upper
    return radius


def centroid_clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: float = 1024.0, seed: int = 3,
    key: str = "vec_id", embedding: str = "embedding",
) -> Clustering:
    """Clusters of the vectors with ``width`` components, each scaled and rounded down to a whole number.

    ``assigned`` has ``vec_id, cluster, distance`` (squared; beyond the range of a long it stays at its end) for every
    vector that takes part, ``centroids`` the final ones. Centroids start as the ``k`` vectors with the smallest sha256 of
    ``seed:vec_id``; each round puts every vector to the nearest one (ties: the smaller number) and moves each centroid to
    the rounded-down mean of its vectors; one without vectors stays. Vectors are put to the nearest once more at the end.
    Rounds end early when no centroid moves, since nothing changes after that.

    Every vector carries an upper bound of the distance to its centroid and a lower bound of that to any other. After a
    move the lower bound gives way by what ``drift`` proves for its cluster's sphere, not by the longest move, and only
    vectors whose bounds meet are computed, in whole numbers. Sums change by the vectors that change cluster. A round is
    one pass without a shuffle of vectors, written to the shared folder, and the round before is deleted; the driver sees
    sums of ``k`` times ``width`` numbers.

    Vectors that are null, of another length, or hold a component that is null or not finite (after scaling, too) take no
    part. Rows without an id are clustered but start no centroid. Repeated rows are vectors of their own; equal starting
    vectors leave the later centroid empty. With fewer than ``k`` vectors that have an id there are fewer centroids, and
    without any nothing is assigned. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    fine = F.forall(
        "x", lambda v: F.coalesce(F.abs(v * F.lit(scale)) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(v)
    )
    rows = (
        vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
        .filter(F.col("x").isNotNull() & (F.size("x") == width) & fine)
    )
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.filter("vec_id IS NOT NULL").select(name.alias("hash"), "x").orderBy("hash", "x").limit(k).collect()
    centroids = [[math.floor(v * scale) for v in row.x] for row in first]
    if not centroids:
        return Clustering(_none(spark), [])

    sums: Centroids = [[0] * (width + 1) for _ in centroids]
    state, folder, moved = rows, None, None
    for _ in range(rounds):
        state, folder = _round(state, folder, _assign(centroids, moved, width, scale))
        radius = _changes(state, sums)
        new = [[v // s[-1] for v in s[:-1]] if s[-1] else old for s, old in zip(sums, centroids)]
        moved = drift(centroids, new, radius)
        if new == centroids:
            break
        centroids = new
    else:
        state, folder = _round(state, folder, _assign(centroids, moved, width, scale))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cluster = _matrix(batch.column("x"), width), batch.column("cluster").to_numpy()
            distance = np.zeros(len(x), np.int64)
            for c in np.unique(cluster):
                own = cluster == c
                distance[own] = [min(LARGEST, int(d)) for d in squared_distances(x[own], [centroids[c]])[:, 0]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("cluster"), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    vectors_only = state.filter("totals IS NULL").select("vec_id", "x", "cluster")
    return Clustering(vectors_only.mapInArrow(measure, "vec_id long, cluster int, distance long"), centroids)


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "vec_id long, cluster int, distance long")


def _round(state: DataFrame, folder: str | None, step) -> tuple[DataFrame, str]:
    spark = state.sparkSession
    written = new_folder(spark, "clusters")
    rows = state.filter("totals IS NULL").drop("totals") if folder else state
    rows.mapInArrow(step, STATE).write.parquet(written)
    if folder:
        remove(spark, folder)
    return spark.read.schema(STATE).parquet(written), written
