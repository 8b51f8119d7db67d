"""Centroid clustering of integer vectors, each assigned by a tournament of bisecting planes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblio_spark.storage import materialize, release

#: Components of up to this size let every product and distance fit in 64 bits (up to 256 of them); larger ones are Python integers.
NARROW = 1 << 26
#: Vectors handled at once.
ROWS = 8192


def integer_vectors(vectors: DataFrame, dim: int = 64, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, x as double, of the vectors with exactly ``dim`` components, none null or
    non-finite. Other columns are left aside; a null id stays."""
    x = vectors[vector_column].cast("array<double>")
    whole = (F.size(x) == dim) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(
        vectors[id_column].cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")
    )


class Bisectors:
    """Planes half way between all pairs of centroids: centroid i beats j > i where ``normals[i, j] . x >= limits[i, j]``."""

    def __init__(self, centroids: list[list[int]]):
        wide = max((abs(c) for row in centroids for c in row), default=0) > NARROW or any(len(row) > 256 for row in centroids)
        self.centroids = np.array(centroids, dtype=object if wide else np.int64).reshape(len(centroids), len(centroids[0]) if centroids else 0)
        self.normals = 2 * (self.centroids[:, None, :] - self.centroids[None, :, :])
        squares = (self.centroids * self.centroids).sum(axis=1)
        self.limits = squares[:, None] - squares[None, :]
        self.wide = wide

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centroid, squared distance) of every point. The winner so far meets each later centroid in one sign test, k - 1 in
        all; a point on the plane goes to the smaller number. Only the winner's distance is computed."""
        if not self.wide and not _narrow(points):
            return Bisectors(self.centroids.tolist())._widened().assign(points)
        points = points.astype(object) if self.wide else points
        best = np.zeros(len(points), dtype=np.int64)
        for j in range(1, len(self.centroids)):
            side = (self.normals[best, j] * points).sum(axis=1) >= self.limits[best, j]
            best[~side.astype(bool)] = j
        apart = points - self.centroids[best]
        distance = (apart * apart).sum(axis=1)
        if self.wide and len(distance) and max(distance) >= 1 << 63:
            raise ValueError("a squared distance does not fit in 64 bits: scale the vectors down")
        return best, distance.astype(np.int64)

    def _widened(self) -> Bisectors:
        self.centroids, self.normals, self.limits = (x.astype(object) for x in (self.centroids, self.normals, self.limits))
        self.wide = True
        return self


def _narrow(points: np.ndarray) -> bool:
    return points.max(initial=0) <= NARROW and points.min(initial=0) >= -NARROW


def _points(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _sums(vectors: DataFrame, centroids: list[list[int]], dim: int) -> list[tuple[int, list[int]] | None]:
    """(members, componentwise sums) of every centroid's vectors, None for an empty one. A task sends k rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Bisectors(centroids)
        totals = np.zeros((len(centroids), dim), dtype=object)
        counts = np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                points = _points(batch.column("v").slice(first, ROWS), dim)
                best, _ = planes.assign(points)
                order = np.argsort(best, kind="stable")
                found, starts = np.unique(best[order], return_index=True)
                small = _narrow(points)
                totals[found] += np.add.reduceat((points if small else points.astype(object))[order], starts, axis=0).astype(object)
                counts += np.bincount(best, minlength=len(counts))
        some = np.flatnonzero(counts)
        text = [[str(x) for x in totals[k]] for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(text, type=pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    parts = vectors.select("v").mapInArrow(partial, "cluster long, n long, sums array<string>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("place", "s"))
    rows = each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out: list = [None] * len(centroids)
    for r in rows:
        if out[r["cluster"]] is None:
            out[r["cluster"]] = (r["n"], [0] * dim)
        out[r["cluster"]][1][r["place"]] = int(r["s"])
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", dim: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector, the final centroids), for what ``integer_vectors`` returns.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order; equal ids (repeated rows)
    follow their components, null ids come last. Each round assigns every vector to the nearest centroid, ties to the
    smaller number, and moves every centroid that has vectors to the exact floor of their mean. Fewer vectors than ``k``
    give as many centroids; an empty table gives no rows and no centroids. A squared distance beyond 64 bits ends the job.

    The vectors are read once for each round and once more; a task sends sums of its own, k * dim numbers, and the driver holds k
    centroids. No vector is shuffled, so clusters of any size are no burden.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.select(key.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = [list(r["v"]) for r in chosen]
    for _ in range(rounds if centroids else 0):
        found = _sums(vectors, centroids, dim)
        centroids = [c if f is None else [s // f[0] for s in f[1]] for c, f in zip(centroids, found, strict=True)]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Bisectors(centroids)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                some = batch.slice(first, ROWS)
                best, distance = planes.assign(_points(some.column("v"), dim))
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(label, "vec_id long, cluster int, distance long"), centroids


def centroid_clusters(
    table: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", dim: int = 64, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per vector kept by ``integer_vectors``: vec_id, cluster, distance (squared), cluster_inertia and inertia (its sum over
    the cluster and over all), centroid_sha256 (of the final centroid's components, comma-joined).

    Vectors that are null, of another length or hold null or non-finite components give no row; repeated rows each give
    one. The integer vectors and the labels are written; totals are k rows.
    """
    vectors = materialize(integer_vectors(table, dim, scale, id_column, vector_column), "vectors")
    labelled, centroids = cluster(vectors, k, rounds, seed, dim)
    labelled = materialize(labelled, "labelled")
    release(vectors)
    totals = labelled.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # at most k rows
    inertia = reduce(lambda a, r: a + r["s"], totals, 0)
    number = F.col("cluster")
    by_cluster = F.create_map(*(F.lit(x) for r in totals for x in (r["cluster"], r["s"]))) if totals else F.create_map().cast("map<int,bigint>")
    names = F.array(*(F.lit(",".join(map(str, c))) for c in centroids)) if centroids else F.array().cast("array<string>")
    return labelled.select(
        "vec_id", "cluster", "distance",
        F.element_at(by_cluster, number).cast("long").alias("cluster_inertia"),
        F.lit(inertia).cast("long").alias("inertia"),
        F.sha2(F.get(names, number), 256).alias("centroid_sha256"),
    )
