"""Centroid clustering in whole numbers: distances to fixed pivots, stored once, rule out centroids by the triangle inequality."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.common import discard, save

#: Pivots, chosen far from one another among this many vectors (those with the smallest hashes): a bound, whatever the table's size.
PIVOTS, SAMPLE = 16, 1024
#: Components in whole numbers stay below this, so that squared distances fit a long.
LARGEST = 1 << 27


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def far_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """The first row of the sample, then again and again the row farthest from those taken (ties: the earlier one); fewer if rows are equal."""
    taken, least = [0], squared(sample, sample[0])
    while len(taken) < pivots and least.max() > 0:
        taken.append(int(least.argmax()))
        least = np.minimum(least, squared(sample, sample[taken[-1]]))
    return sample[taken]


def assign(x: np.ndarray, far: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row the nearest centroid (ties: smaller number), its exact squared distance, and how many distances were worked out.

    far holds the rows' squared distances to the pivots. A centroid c is no nearer than |d(x, p) - d(c, p)| for each pivot p; it is
    left out where the largest of these, less what rounding may add, exceeds the distance already found.
    """
    bound = np.zeros((len(x), len(centroids)))
    own = np.sqrt(far.astype(np.float64))
    for k, c in enumerate(centroids):
        to = np.sqrt(squared(pivots, c).astype(np.float64))
        bound[:, k] = np.maximum(np.abs(own - to).max(axis=1) * (1 - 1e-9) - 1e-4, 0) ** 2 * (1 - 1e-9)
    number = bound.argmin(axis=1)
    best, asked = np.zeros(len(x), np.int64), len(x)
    for k, c in enumerate(centroids):
        rows = np.flatnonzero(number == k)
        best[rows] = squared(x[rows], c)
    first = number.copy()
    for k, c in enumerate(centroids):
        rows = np.flatnonzero((first != k) & (bound[:, k] <= best))
        found = squared(x[rows], c)
        better = (found < best[rows]) | ((found == best[rows]) & (k < number[rows]))
        best[rows[better]], number[rows[better]] = found[better], k
        asked += len(rows)
    return number, best, asked


def _block(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def whole_vectors(vectors: DataFrame, dimension: int, scale: int, id_col: str, vector: str) -> DataFrame:
    """Rows (vec_id, x): the vectors of `dimension` components, none null or non-finite, each component as floor(scale * component)."""
    slim = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("v"))
    good = slim.where(f"size(v) = {dimension} and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('inf'))")
    return good.select("vec_id", F.expr(f"transform(v, c -> case when abs(c) < {LARGEST // scale} then cast(floor({scale} * cast(c as double)) as int) else cast(raise_error('a component is too large for exact distances') as int) end)").alias("x"))


def kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3:", dimension: int = 64, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each kept vector, after `rounds` rounds.

    Kept are vectors of `dimension` components without null or non-finite ones, as whole numbers floor(scale * component); a kept
    component of LARGEST // scale or more raises an error, as distances would not fit a long. Centroids 0, 1, ... start as the k kept
    vectors with the smallest SHA-256 of seed and id (null ids last; rows of one id by their components); with fewer than k kept
    vectors there are fewer. Equal distances go to the smaller number; a centroid without vectors stays. No kept vectors: no rows.
    Repeated rows count each; other columns aren't read.

    Vectors and their distances to PIVOTS fixed pivots are written once to shared storage. Each round is one pass over that table
    without a shuffle of vectors: tasks send at most k sums. Only centroids, pivots and the bounded sample pass through the driver. The
    pivots are the far rows of the SAMPLE vectors of smallest hash; they change the work, never the result.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, dimension, scale, id_col, vector)
    order = [F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("x")]
    sample = np.array([r.x for r in whole.orderBy(*order).limit(max(SAMPLE, k)).select("x").collect()], np.int64).reshape(-1, dimension)
    if not len(sample):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, pivots = sample[:k].copy(), far_pivots(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _block(batch.column("x"), dimension)
            far = np.stack([squared(x, p) for p in pivots], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(pivots)), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), lists], names=["vec_id", "x", "far"])

    kept = save(whole.select(F.col("vec_id").cast("long"), "x").mapInArrow(measure, "vec_id long, x array<int>, far array<long>"))
    for _ in range(rounds):
        for cluster, n, sums in _sums(kept, centroids, pivots):
            centroids[cluster] = [s // n for s in sums]
    assigned = save(_assigned(kept, centroids, pivots))
    totals = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    inertia = sum(int(r.total) for r in totals)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = spark.createDataFrame([(r.cluster, int(r.total), inertia, digests[r.cluster]) for r in totals], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    discard(kept)
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sums(kept: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(cluster, vectors, sum of each component) of every cluster that has vectors."""
    k, dimension = centroids.shape
    now = centroids.copy()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dimension + 1), np.int64)
        for batch in batches:
            x = _block(batch.column("x"), dimension)
            number, _, _ = assign(x, _block(batch.column("far"), len(pivots)), now, pivots)
            for c in range(k):
                mine = x[number == c]
                total[c] += np.append(mine.sum(axis=0), len(mine))
        c, at = np.nonzero(total)
        yield pa.record_batch({"cluster": pa.array(c, pa.int32()), "at": pa.array(at, pa.int32()), "total": pa.array(total[c, at], pa.int64())})

    sums = np.zeros((k, dimension + 1), object)
    for r in kept.select("x", "far").mapInArrow(add, "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        sums[r.cluster, r["at"]] = int(r.total)
    return [(c, row[dimension], row[:dimension]) for c, row in enumerate(sums.tolist()) if row[dimension]]


def _assigned(kept: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    dimension, now = centroids.shape[1], centroids.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, best, _ = assign(_block(batch.column("x"), dimension), _block(batch.column("far"), len(pivots)), now, pivots)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, "vec_id long, cluster int, distance long")
