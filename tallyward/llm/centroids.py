"""Centroid clustering of integer vectors by Orchard's search, exact in every round.

Lloyd's rounds: each vector goes to its nearest centroid, each centroid moves to
the floor of the mean of its vectors. The search for the nearest centroid walks
the list of the present best one, in which all centroids stand by their distance
to it. Whenever a closer centroid turns up, the walk starts anew in that one's
list; centroids met before are marked and not measured again. It stops at the
first entry that lies strictly beyond twice the present distance: by the
triangle inequality that entry and all after it are farther away than the
present best one. Entries at exactly twice the distance may tie and are still
measured, and a tie goes to the smaller number, so the result is that of a full
comparison.

A round is one pass over the vectors with one row per task, centroid and
component to shuffle, summed before it moves; no vector is shuffled at all, so
neither a large cluster nor a vector that very many rows share makes a hot task.
What reaches the driver and goes to every task is k centroids.

Odd rows: a vector that is null, of another size, or holds a null or non-finite
component is left out. A null key counts as the empty text when seeds are drawn.
Rows with equal keys each count. Equal vectors and equal centroids are ties as
above. With fewer vectors than k there are as many centroids as vectors; without
any, the result is empty. Only the key and the vector are read, so other columns
may have any name. Components may have any finite size; a squared distance that
does not fit into 64 bits raises an error instead of wrapping around.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.llm.common import sliced, stored

WHOLE = pa.decimal128(38, 0)


def usable(vector: str, size: int) -> Column:
    """Whether a vector has exactly ``size`` components, all finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def in_units(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each number, as Python integers where 64 bits are too few."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if not len(scaled) or np.abs(scaled).max() < 2**53:
        return scaled.astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale) for v in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def _narrow(values: np.ndarray) -> bool:
    """Whether squared distances between such vectors fit into 64 bits."""
    return values.dtype != object and (not values.size or values.shape[-1] * (2 * int(np.abs(values).max())) ** 2 < 2**62)


def squares(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(axis=-1)


def neighbour_lists(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all centroids by distance to it, then number, itself first; and those distances."""
    gaps = np.stack([squares(centres - c) for c in centres])
    order = np.array([sorted(range(len(row)), key=lambda j: (j != i, row[j], j)) for i, row in enumerate(gaps)])
    return order, np.take_along_axis(gaps, order, axis=1)


def orchard(points: np.ndarray, centres: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each point, its squared distance, and how many distances were measured."""
    order, gaps = lists
    n, k = len(points), len(centres)
    best = np.zeros(n, np.int64)
    near = squares(points - centres[0])
    met = np.zeros((n, k), bool)
    met[:, 0] = True
    place = np.ones(n, np.int64)
    measured = n
    walking = np.arange(n)
    while True:
        walking = walking[place[walking] < k]
        walking = walking[gaps[best[walking], place[walking]] <= 4 * near[walking]]
        if not len(walking):
            return best, near, measured
        candidate = order[best[walking], place[walking]]
        place[walking] += 1
        new = ~met[walking, candidate]
        rows, candidate = walking[new], candidate[new]
        met[rows, candidate] = True
        measured += len(rows)
        distance = squares(points[rows] - centres[candidate])
        closer = (distance < near[rows]) | ((distance == near[rows]) & (candidate < best[rows]))
        rows, candidate = rows[closer], candidate[closer]
        best[rows], near[rows], place[rows] = candidate, distance[closer], 1


def _assigned(batches: Iterator[pa.RecordBatch], centres: list[list[int]], scale: int):
    """(batch, points, nearest centroid, squared distance) of each piece of the input."""
    middle = in_units(np.array(centres, object), 1) if max(abs(x) for c in centres for x in c) >= 2**53 else np.array(centres, np.int64)
    lists = None
    for batch in sliced(batches):
        if not batch.num_rows:
            continue
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        points, target = in_units(values, scale), middle
        if not (_narrow(points) and _narrow(target)):
            points, target = points.astype(object), target.astype(object)
            best, near, _ = orchard(points, target, neighbour_lists(target))
        else:
            lists = lists or neighbour_lists(middle)
            best, near, _ = orchard(points, target, lists)
        yield batch, points, best, near


def _sums(centres: list[list[int]], scale: int) -> Callable:
    """One row per centroid and component of a task: the sum over its vectors, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(centres[0])
        total = np.zeros((len(centres), size), object)
        count = np.zeros(len(centres), np.int64)
        for _, points, best, _ in _assigned(batches, centres, scale):
            for c in np.unique(best):
                mine = points[best == c]
                total[c] += mine.sum(axis=0).astype(object)
                count[c] += len(mine)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, size), pa.int32()),
                pa.array(np.tile(np.arange(size), len(used)), pa.int32()),
                pa.array([int(x) for c in used for x in total[c]], WHOLE),
                pa.array(np.repeat(count[used], size), pa.int64()),
            ],
            names=["centroid", "component", "total", "n"],
        )

    return run


def _labels(centres: list[list[int]], scale: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, best, near in _assigned(batches, centres, scale):
            if near.dtype == object and max(near) >= 2**63:
                raise OverflowError("a squared distance does not fit into 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(near.tolist(), pa.int64())], names=names)

    return run


def seeds(rows: DataFrame, key: str, vector: str, k: int, salt: int, scale: int) -> list[list[int]]:
    """The vectors whose salted keys have the k smallest digests; k rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    drawn = rows.select(digest.alias("digest"), F.col(vector).alias("vector")).orderBy("digest", "vector").limit(k).collect()
    return [in_units(np.array(r.vector, np.float64), scale).tolist() for r in drawn]


def moved(rows: DataFrame, centres: list[list[int]], scale: int) -> list[list[int]]:
    """Centroids after one round: the floor of the mean of each one's vectors; empty ones stay."""
    parts = rows.mapInArrow(_sums(centres, scale), "centroid int, component int, total decimal(38,0), n bigint")
    new = [list(c) for c in centres]
    for r in parts.groupBy("centroid", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        new[r.centroid][r.component] = int(r.total) // r.n
    return new


def clustered(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, salt: int = 2
) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(vector, size)).select(F.col(key), F.col(vector))
    centres = seeds(rows, key, vector, k, salt, scale)
    for _ in range(rounds if centres else 0):
        centres = moved(rows, centres, scale)
    shape = T.StructType([T.StructField("_key", rows.schema[key].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    found = rows.mapInArrow(_labels(centres, scale, shape.names), shape) if centres else spark.createDataFrame([], shape)
    found = stored(found, "clusters")
    totals = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    described = [
        (c, total, sum(totals.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for c, total in sorted(totals.items())
    ]
    facts = spark.createDataFrame(described, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row for each of the k centroids
    joined = found.join(F.broadcast(facts), "cluster")
    return joined.select(F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
