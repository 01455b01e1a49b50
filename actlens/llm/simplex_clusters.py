"""Exact integer k-means whose comparisons are filtered by n-simplex bounds.

The first centroids and those of the first round are the pivots. Every vector's distances
to them are taken once and kept as apex coordinates beside the vector; a round then
bounds the distance to each centroid from a few coordinates, and compares whole vectors
with the rest only. Later centroids lie near the hull of these pivots, so their heights
are small and the bounds close.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.llm.simplex import Simplex, nearest
from actlens.session import materialize

# Components are below this in size, so that squared distances fit 64 bits at any usual width.
LARGEST = 1 << 27


def usable(vector: Column, width: int) -> Column:
    """True for vectors of ``width`` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def _integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    scaled = np.floor(scale * values)
    if (np.abs(scaled) >= LARGEST).any():
        raise ValueError(f"scaled components must be below {LARGEST} in size")
    return scaled.astype(np.int64)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(matrix.ravel(), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), flat)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _projected(rows: DataFrame, simplex: Simplex, width: int, scale: int) -> DataFrame:
    """``id``, ``v`` (integers) and ``apex`` (coordinates) of every vector."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _integers(batch.column("vector"), width, scale)
            apexes = simplex.apexes(simplex.distances(vectors))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), _lists(vectors, pa.int32()), _lists(apexes, pa.float64())], ["id", "v", "apex"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(project, f"id {kind}, v array<int>, apex array<double>")


def _moved(cached: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """The centroids of the next round; a task sends one sum per cluster and component at most."""
    k, width = centroids.shape
    tops = simplex.apexes(simplex.distances(centroids))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("v"), width).astype(np.int64)
            cluster, _, _ = nearest(vectors, _matrix(batch.column("apex"), tops.shape[1]), centroids, tops)
            np.add.at(sums, cluster, np.column_stack([vectors, np.ones(len(vectors), np.int64)]))
        some = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), _lists(sums[some], pa.int64())], ["cluster", "sums"])

    parts = cached.select("v", "apex").mapInArrow(partial, "cluster int, sums array<long>")
    # k * (width + 1) rows, whatever the table.
    totals = parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("total"))
    found = {(r.cluster, r.pos): r.total for r in totals.collect()}
    out = centroids.copy()
    for c in range(k):
        if found.get((c, width)):
            out[c] = [found[c, j] // found[c, width] for j in range(width)]
    return out


def cluster_vectors(
    vectors: DataFrame,
    vector: str = "embedding",
    id: str = "vec_id",
    k: int = 16,
    rounds: int = 3,
    width: int = 64,
    scale: int = 64,
    seed: int = 1,
) -> DataFrame:
    """``id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of every usable vector.

    Components x become floor(``scale`` * x). The ``k`` vectors whose ids have the smallest
    SHA-256 of ``<seed>:<id>`` are the first centroids, in that order. Each round assigns all
    vectors (squared Euclidean distance, ties to the smaller number) and moves each
    centroid with vectors to the floored mean; then vectors are assigned once more.

    * Vectors that are null, of another width, or hold a null or non-finite component take no part.
    * With fewer than ``k`` vectors there are as many centroids; an empty table gives an empty result.
    * Rows with equal ids tie in the choice of first centroids and are told apart by their
      components; a null id counts as the empty one.
    * Equal vectors are in one cluster. Two centroids may be equal; the smaller number gets all.
    * A scaled component of 2^27 or more in size is an error, as distances would leave 64 bits.
    * Other columns are not read.

    Only centroids reach the driver: k vectors, and k * (width + 1) sums a round.
    """
    numbers = f"array<{vectors.schema[vector].dataType.elementType.simpleString()}>"
    rows = vectors.where(usable(F.col(vector), width)).select(
        F.col(id).alias("id"), F.col(vector).cast(numbers).alias("vector")
    )
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [r.vector for r in rows.orderBy(order, "vector").limit(k).collect()]
    kind = rows.schema["id"].dataType.simpleString()
    if not first:
        schema = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = _integers(pa.array(first, pa.list_(pa.float64())), width, scale)
    pivots = centroids
    if rounds:
        simplex = Simplex(pivots)
        centroids = _moved(_projected(rows, simplex, width, scale), simplex, centroids)
        pivots = np.vstack([pivots, centroids])
    simplex = Simplex(pivots)
    cached = materialize(_projected(rows, simplex, width, scale), "apexes")
    for _ in range(1, rounds):
        centroids = _moved(cached, simplex, centroids)
    tops = simplex.apexes(simplex.distances(centroids))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _matrix(batch.column("v"), width).astype(np.int64)
            cluster, distance, _ = nearest(whole, _matrix(batch.column("apex"), tops.shape[1]), centroids, tops)
            digest = pa.array(digests).take(pa.array(cluster))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), digest],
                ["id", "cluster", "distance", "centroid_sha256"],
            )

    assigned = materialize(
        cached.mapInArrow(assign, f"id {kind}, cluster int, distance long, centroid_sha256 string"), "assigned"
    )
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows
    total = assigned.agg(F.sum("distance").alias("inertia")).scalar()
    return assigned.join(F.broadcast(inertia), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256"
    )
