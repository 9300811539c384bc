"""Centroid clustering of integer vectors, filtered in a rotated space.

The vectors' covariance gives an orthogonal rotation whose first coordinates carry
most of the spread. A vector is stored as its integers, as many rotated coordinates
as carry SPREAD of the variance, and the norm of the rest. For any vector x and centroid c

    |x - c|^2  >=  |leading(x) - leading(c)|^2 + (rest(x) - rest(c))^2

so one exact distance, that to the centroid with the smallest bound, rules out every
centroid whose bound lies above it. The others are compared in integers. The
rotation only decides how many survive, never which centroid is nearest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.shared import column
from recordloom.session import materialise

DIMENSIONS = 64
SCALE = 64  # an integer component is floor(SCALE * x)
CENTROIDS = 16
ROUNDS = 3
SPREAD = 0.85  # of the variance, in the rotated coordinates that are stored
WIDEST = 1 << 27  # components beyond +-this are set to it: distances fit into 64 bits
AT_ONCE = 4096  # vectors that are compared at once
#: Share of the squared lengths that rounding the stored coordinates to 24 bits may
#: cost a bound.
ROUNDING = 4e-6


@dataclass(frozen=True)
class Rotation:
    """``axes`` has one row per rotated coordinate, the widest spread first."""

    centre: np.ndarray
    axes: np.ndarray
    leading: int

    def apply(self, vectors: np.ndarray) -> np.ndarray:
        """Leading coordinates and, behind them, the norm of the others."""
        turned = (vectors - self.centre) @ self.axes.T
        rest = np.sqrt((turned[:, self.leading :] ** 2).sum(axis=1))
        return np.column_stack([turned[:, : self.leading], rest])


def integers(batch: pa.RecordBatch, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a batch, and their integers."""
    vectors = batch.column("_vector")
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    right = lengths == dimensions
    places = np.flatnonzero(right)
    values = vectors.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
    values = values.astype(np.float64).reshape(-1, dimensions)  # a null comes out as NaN
    finite = np.isfinite(values).all(axis=1)
    whole = np.clip(np.floor(values[finite] * scale), -WIDEST, WIDEST)
    return places[finite], whole.astype(np.int64)


def _keeper(dimensions: int, scale: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, whole = integers(batch, dimensions, scale)
            offsets = np.arange(len(whole) + 1, dtype=np.int32) * dimensions
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole.ravel().astype(np.int32)))
            ids = batch.column("vec_id").take(pa.array(places))
            yield pa.RecordBatch.from_arrays([ids, rows], ["vec_id", "whole"])

    return run


def _matrix(vectors: pa.Array, kind=np.int64) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(vectors), -1)


def _moments(dimensions: int):
    """Sums of coordinates and of their products, one row per place of the matrix."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions + 1, dimensions + 1))
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column("whole"), np.float64)
                rows = np.column_stack([np.ones(len(rows)), rows])
                total += rows.T @ rows
        if total[0, 0]:
            places = pa.array(np.arange(total.size), pa.int32())
            yield pa.RecordBatch.from_arrays([places, pa.array(total.ravel())], ["place", "value"])

    return run


def fit_rotation(kept: DataFrame, dimensions: int, share: float) -> Rotation:
    """The principal axes of all vectors. One (d + 1) x (d + 1) matrix comes to the
    driver, whatever the number of rows."""
    sums = (
        kept.select("whole").mapInArrow(_moments(dimensions), "place int, value double")
        .groupBy("place").agg(F.sum("value").alias("value")).collect()
    )
    total = np.zeros((dimensions + 1) ** 2)
    for row in sums:
        total[row.place] = row.value
    total = total.reshape(dimensions + 1, dimensions + 1)
    count = max(total[0, 0], 1.0)
    centre = total[0, 1:] / count
    spread = total[1:, 1:] / count - np.outer(centre, centre)
    widths, axes = np.linalg.eigh((spread + spread.T) / 2)  # ascending
    carried = np.cumsum(np.maximum(widths[::-1], 0))
    leading = int(np.searchsorted(carried, share * carried[-1])) + 1
    return Rotation(centre, axes.T[::-1].copy(), min(leading, dimensions))


def _rotator(rotation: Rotation):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = rotation.apply(_matrix(batch.column("whole"), np.float64))
            offsets = np.arange(len(turned) + 1, dtype=np.int32) * turned.shape[1]
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(turned.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], ["vec_id", "whole", "turned"])

    return run


def nearest(
    whole: np.ndarray, turned: np.ndarray, centroids: np.ndarray, rotation: Rotation
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), its squared
    distance, and how many exact distances were computed."""
    seen = rotation.apply(centroids.astype(np.float64))
    bounds = ((turned[:, None, :] - seen[None, :, :]) ** 2).sum(axis=2)
    lengths = (whole.astype(np.float64) ** 2).sum(axis=1)[:, None]
    lengths = lengths + (centroids.astype(np.float64) ** 2).sum(axis=1)[None, :]
    lengths += 2 * (rotation.centre**2).sum() + 1
    bounds -= ROUNDING * lengths
    first = bounds.argmin(axis=1)
    distance = ((whole - centroids[first]) ** 2).sum(axis=1)
    rows, others = np.nonzero(bounds <= distance[:, None])
    more = others != first[rows]
    rows, others = rows[more], others[more]
    exact = ((whole[rows] - centroids[others]) ** 2).sum(axis=1)
    # The best of each vector's survivors: sorted by row, distance, number.
    rows = np.concatenate([np.arange(len(whole)), rows])
    others, exact = np.concatenate([first, others]), np.concatenate([distance, exact])
    order = np.lexsort((others, exact, rows))
    best = order[np.unique(rows[order], return_index=True)[1]]
    return others[best], exact[best], len(rows)


def _assigned(batches, centroids: np.ndarray, rotation: Rotation):
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            some = batch.slice(at, AT_ONCE)
            whole = _matrix(some.column("whole"))
            turned = _matrix(some.column("turned"), np.float64)
            yield some, whole, *nearest(whole, turned, centroids, rotation)


def _summer(centroids: np.ndarray, rotation: Rotation):
    """Count and componentwise sums of the vectors of every cluster, by task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for _, whole, cluster, _, _ in _assigned(batches, centroids, rotation):
            np.add.at(sums, cluster, np.column_stack([np.ones(len(whole), np.int64), whole]))
        for number in np.flatnonzero(sums[:, 0]):
            yield pa.RecordBatch.from_pydict(
                {
                    "cluster": pa.array([number] * sums.shape[1], pa.int32()),
                    "place": pa.array(np.arange(sums.shape[1]), pa.int32()),
                    "value": pa.array(sums[number]),
                }
            )

    return run


def _assigner(centroids: np.ndarray, rotation: Rotation):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for some, _, cluster, distance, compared in _assigned(batches, centroids, rotation):
            counts = np.zeros(len(cluster), np.int64)
            counts[:1] = compared
            yield pa.RecordBatch.from_arrays(
                [some.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(counts)],
                ["vec_id", "cluster", "distance", "compared"],
            )

    return run


def start_hash(number: int = 1):
    """The order of the vectors that centroids start from."""
    return F.sha2(F.concat(F.lit(f"{number}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


@dataclass(frozen=True)
class Clusters:
    """Vectors as stored for the search, and what was fitted on them."""

    vectors: DataFrame  # vec_id, whole, turned
    rotation: Rotation
    centroids: np.ndarray  # one row each, int64


def store(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
    dimensions: int = DIMENSIONS, scale: int = SCALE, share: float = SPREAD,
) -> tuple[DataFrame, Rotation]:
    """(vec_id, whole, turned) of the usable vectors, stored once, and the rotation.

    Usable are vectors with exactly ``dimensions`` components, none of them null or
    non-finite. Components beyond WIDEST after scaling are set to it.
    """
    rows = vectors.select(column(vec_id).cast("bigint").alias("vec_id"), column(vector).alias("_vector"))
    kept = rows.mapInArrow(_keeper(dimensions, scale), "vec_id bigint, whole array<int>")
    kept = materialise(kept, "integer-vectors")
    rotation = fit_rotation(kept, dimensions, share)
    turned = kept.mapInArrow(_rotator(rotation), "vec_id bigint, whole array<int>, turned array<float>")
    return materialise(turned, "rotated-vectors"), rotation


def fit(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, vec_id: str = "vec_id",
    vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, share: float = SPREAD,
) -> Clusters:
    """Start from the ``k`` vectors with the smallest hashes of their ids and repeat:
    assign every vector to its nearest centroid, move every centroid that has
    vectors to the floor of their mean.

    Rows with the same id take their turn in the order of their components; a null
    id is hashed as an empty one. Fewer usable vectors than ``k`` make fewer
    centroids, none make none. Each round brings at most k x (d + 1) sums to the
    driver; a task hands over the sums of its rows, so no cluster is too large.
    """
    stored, rotation = store(vectors, vec_id, vector, dimensions, scale, share)
    first = stored.select(start_hash().alias("_hash"), "whole").orderBy("_hash", "whole").limit(k)
    starts = [row.whole for row in first.collect()]
    centroids = np.array(starts, np.int64).reshape(-1, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        sums = (
            stored.mapInArrow(_summer(centroids, rotation), "cluster int, place int, value bigint")
            .groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
            .collect()
        )
        total = [[0] * (dimensions + 1) for _ in centroids]
        for row in sums:
            total[row.cluster][row.place] = int(row.value)
        centroids = np.array(
            [[x // s[0] for x in s[1:]] if s[0] else list(c) for c, s in zip(centroids.tolist(), total, strict=True)],
            np.int64,
        )
    return Clusters(stored, rotation, centroids)


def assign(clusters: Clusters) -> DataFrame:
    """vec_id, cluster, distance (squared) of every stored vector, and in ``compared``
    how many exact distances its batch needed (on the first row of the batch)."""
    if not len(clusters.centroids):
        return clusters.vectors.sparkSession.createDataFrame(
            [], "vec_id bigint, cluster int, distance bigint, compared bigint"
        )
    return clusters.vectors.mapInArrow(
        _assigner(clusters.centroids, clusters.rotation),
        "vec_id bigint, cluster int, distance bigint, compared bigint",
    )


def report(clusters: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every
    usable vector. Inertias that pass 64 bits are null."""
    placed = materialise(assign(clusters), "assigned")
    spark = placed.sparkSession
    sums = {
        row.cluster: int(row.inertia)
        for row in placed.groupBy("cluster")
        .agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    }

    def long(value: int) -> int | None:
        return value if value < 1 << 63 else None

    every = long(sum(sums.values()))
    digests = [
        (number, long(sums.get(number, 0)), every, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for number, row in enumerate(clusters.centroids.tolist())
    ]
    # One row per centroid.
    facts = spark.createDataFrame(
        digests, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return placed.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
