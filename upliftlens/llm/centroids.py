"""Exact integer k-means whose comparisons are filtered by n-simplex projection.

Each vector's distances to a few pivots are taken once. With the pivots as the base of a simplex they give
the coordinates of its apex, which are stored with the vector. The Euclidean distance of two apexes is a lower
bound of the distance of what they stand for; with the last coordinate of one of them mirrored it is an upper
bound. A centroid whose lower bound exceeds the least upper bound of all centroids can't be the nearest one;
the others are compared as integers. The pivots stay, so a round projects the centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upliftlens.llm.common import Scratch, map_arrow

#: Larger components are taken as this, so that squared distances fit into 64 bits.
LARGEST = 1 << 27
#: Share of a distance by which rounding may move a bound.
SLACK = 1e-6
#: A pivot whose height over the others is a smaller share of its distance from the first is left out.
FLAT = 1e-2
#: Vectors compared at once.
ROWS = 4096


class Simplex:
    """A simplex over pivots, made of their mutual distances; pivots that lie within the others' span are left out."""

    def __init__(self, candidates: np.ndarray) -> None:
        self.pivots = candidates[:1]
        self.base = np.zeros((1, 0))
        for candidate in candidates[1:]:
            at = self.apex(squared(candidate[None], self.pivots))[0]
            if at[-1] > FLAT * np.sqrt((at**2).sum()):
                self.base = np.vstack([np.pad(self.base, ((0, 0), (0, len(at) - self.base.shape[1]))), at])
                self.pivots = np.vstack([self.pivots, candidate])

    def apex(self, distances: np.ndarray) -> np.ndarray:
        """The coordinates of points with these squared distances to the pivots; the last one is the height."""
        d = distances.astype(np.float64)
        out = np.zeros(d.shape)
        for i in range(1, d.shape[1]):
            p = self.base[i]
            known = out[:, : i - 1] @ p[: i - 1]
            out[:, i - 1] = ((d[:, 0] - d[:, i] + p @ p) / 2 - known) / p[i - 1]
        out[:, -1] = np.sqrt(np.maximum(0, d[:, 0] - (out[:, :-1] ** 2).sum(axis=1)))
        return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `a` to the few rows of `b`, exact."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the nearest centroid (of equal ones the first) and its squared distance, and the exact comparisons made."""
    own = simplex.apex(squared(centroids, simplex.pivots))
    flat = ((apexes[:, None, :-1] - own[None, :, :-1]) ** 2).sum(axis=2)
    height, other = apexes[:, -1][:, None], own[:, -1][None]
    lower, upper = np.sqrt(flat + (height - other) ** 2), np.sqrt(flat + (height + other) ** 2)
    slack = SLACK * (np.sqrt((apexes**2).sum(axis=1))[:, None] + np.sqrt((own**2).sum(axis=1))[None]) + SLACK
    rows, places = np.nonzero(lower - slack <= (upper + slack).min(axis=1)[:, None])
    exact = np.full(lower.shape, np.iinfo(np.int64).max)
    exact[rows, places] = ((vectors[rows] - centroids[places]) ** 2).sum(axis=1)
    best = exact.argmin(axis=1)
    return best, exact[np.arange(len(best)), best], len(rows)


def _vectors(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _project(simplex: Simplex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch.column("v"), simplex.pivots.shape[1], np.int64)
            apexes = simplex.apex(squared(vectors, simplex.pivots)) if len(vectors) else np.zeros((0, 1))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(apexes.ravel()), apexes.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns, lists], names=[*batch.schema.names, "apex"])

    return run


def _compared(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, simplex: Simplex):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            vectors = _vectors(part.column("v"), centroids.shape[1], np.int64)
            yield part, vectors, *nearest(vectors, _vectors(part.column("apex"), len(simplex.pivots), np.float64), centroids, simplex)


def _sums(centroids: np.ndarray, simplex: Simplex):
    """The sum of each cluster's vectors by component, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        total, members = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, vectors, best, _, _ in _compared(batches, centroids, simplex):
            for c in range(k):
                total[c] += vectors[best == c].sum(axis=0)
            members += np.bincount(best, minlength=k)
        some = np.flatnonzero(members)
        columns = [np.repeat(some, width), np.tile(np.arange(width), len(some)), total[some].ravel(), np.repeat(members[some], width)]
        yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["cluster", "place", "total", "n"])

    return run


def _assign(centroids: np.ndarray, simplex: Simplex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, best, distance, _ in _compared(batches, centroids, simplex):
            columns = [part.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)]
            yield pa.record_batch(columns, names=["vec_id", "cluster", "distance"])

    return run


def integers(vector: Column, width: int, scale: int) -> tuple[Column, Column]:
    """Whether a vector has `width` finite components, and floor(scale * component) of each."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.size(vector).eqNullSafe(F.lit(width)) & ~F.coalesce(broken, F.lit(True))

    def component(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.floor(F.least(F.greatest(scaled, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int")

    return whole, F.transform(vector, component)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(
    table: DataFrame, scratch: Scratch | None = None, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, pivots: int = 12
) -> DataFrame:
    """(vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    One row for each vector of `width` components, none NULL or not finite; others have none, and a table
    without such vectors gives no rows. Centroids start as the `k` vectors (or all, if fewer) with the
    smallest SHA-256 of `1:<vec_id>`; a NULL id comes last, and rows that repeat an id by their components.
    Components beyond 2^27 / scale count as that. Ties go to the centroid with the smaller number. Rows that
    repeat an id are vectors of their own. Other columns are ignored. Only centroids, sums of at most `k` *
    `width` numbers for each task, and the chosen vectors move; the driver holds `k` vectors.
    """
    scratch = scratch or Scratch(table.sparkSession)
    whole, v = integers(F.col("embedding"), width, scale)
    kept = table.select("vec_id", "embedding").filter(whole).select("vec_id", v.alias("v"))
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.select("v", name.alias("name")).orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()
    spark = table.sparkSession
    vec_id = table.schema["vec_id"].dataType.simpleString()
    if not first:
        empty = f"vec_id {vec_id}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    centroids = np.array([r.v for r in first], np.int64)
    simplex = Simplex(centroids[: max(1, pivots)])
    points = scratch.save(map_arrow(kept, _project(simplex), f"vec_id {vec_id}, v array<int>, apex array<double>"), "points")
    for _ in range(rounds):
        partial = map_arrow(points, _sums(centroids, simplex), "cluster long, place long, total long, n long")
        exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        centroids = centroids.copy()
        for r in partial.groupBy("cluster", "place").agg(exact, F.sum("n").alias("n")).collect():  # k * width rows at most
            centroids[r.cluster, r.place] = int(r.total) // r.n
    found = scratch.save(map_arrow(points, _assign(centroids, simplex), f"vec_id {vec_id}, cluster int, distance long"), "assigned")
    parts = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    parts = {r.cluster: int(r.part) for r in parts.collect()}  # k rows at most
    whole_sum, digests = sum(parts.values()), [digest(c) for c in centroids]
    rows = [(c, part, whole_sum, digests[c]) for c, part in sorted(parts.items())]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
