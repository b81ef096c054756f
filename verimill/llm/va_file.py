"""Centroid clustering over a VA-file: vectors compressed to a few bits a dimension decide most assignments without the vectors themselves.

Each dimension is cut into cells of about equally many vectors. For a set of centroids, lookup tables hold the least and largest
share of each cell in the distance to each centroid; summed over the dimensions they give an interval of the distance. A vector whose interval of one
centroid lies below all others is assigned; full vectors are fetched only where intervals overlap, or where a vector changed its cluster and
the sums have to follow. Each round thus reads the compressed file, deals the keys to fetch to the buckets of the full table, which stays
where it is, and sums the changes; nothing but k centroids and their sums comes to the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, delete, drop_cut, scratch_dir

#: Bits of a cell.
BITS = 8
#: Vectors of a bucket of the full table, about.
BUCKET_VECTORS = 200_000
#: Components beyond this would let a squared distance of 64 of them pass 63 bits.
LARGEST = 1 << 27


def kept_vectors(vectors: DataFrame, dimension: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v) of vectors with exactly `dimension` components, none null or non-finite: each component x is the integer floor(scale * x).
    Vectors with an integer beyond LARGEST are left out, since their distances wouldn't fit into a long."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) <= LARGEST))
    return vectors.filter((F.size("embedding") == dimension) & fine).select("vec_id", x.cast("array<int>").alias("v"))


def edges(full: DataFrame, dimension: int, bits: int = BITS) -> np.ndarray:
    """First integers of the cells of each dimension, then one past the largest value: quantiles, mergeable sketches of bounded size."""
    cells = 1 << bits
    shares = [k / cells for k in range(1, cells)]
    v = lambda d: F.col("v")[d]
    found = full.agg(*[f(v(d)) for d in range(dimension) for f in (F.min, lambda c: F.percentile_approx(c, shares, 1000), F.max)]).first()
    return np.array([[found[3 * d], *found[3 * d + 1], found[3 * d + 2] + 1] for d in range(dimension)], np.int64)


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dimension)


def cells_of(v: np.ndarray, edge: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edge[d, 1:-1], v[:, d], side="right") for d in range(len(edge))], axis=1).astype(np.uint8)


def packed(cells: np.ndarray, bits: int) -> np.ndarray:
    planes = np.unpackbits(cells[:, :, None], axis=2, bitorder="little", count=bits)
    return np.packbits(planes.reshape(len(cells), -1), axis=1)


def unpacked(data: np.ndarray, dimension: int, bits: int) -> np.ndarray:
    planes = np.unpackbits(data, axis=1, count=dimension * bits).reshape(len(data), dimension, bits)
    return np.packbits(planes, axis=2, bitorder="little")[:, :, 0]


def possible(cells: np.ndarray, edge: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to each vector, by its cells alone.

    The tables hold what a cell can add to the squared distance to each centroid, less the distance to the middle of all centroids: that part
    is common to them, and without it the intervals are the narrower the nearer the centroids are to each other.
    """
    low, high = edge[:, :-1], np.maximum(edge[:, 1:] - 1, edge[:, :-1])  # an empty cell has no vector
    place = cells.astype(np.int64) + np.arange(len(edge)) * low.shape[1]
    least, most = np.empty((len(centroids), len(cells)), np.int64), np.empty((len(centroids), len(cells)), np.int64)
    middle = (centroids.sum(axis=0) // len(centroids))[:, None]
    for k, c in enumerate(centroids):
        c = c[:, None]
        a, b = (middle - c) * (2 * low - c - middle), (middle - c) * (2 * high - c - middle)  # (v - c)^2 - (v - middle)^2 is linear in v
        least[k] = np.minimum(a, b).ravel()[place].sum(axis=1)
        most[k] = np.maximum(a, b).ravel()[place].sum(axis=1)
    return (least <= most.min(axis=0)).T


def nearest(v: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each vector, the smaller number of equally near ones; only those of `among` are computed."""
    far = np.full(among.shape, np.iinfo(np.int64).max)
    for k, c in enumerate(centroids):
        rows = np.flatnonzero(among[:, k])
        d = v[rows] - c
        far[rows, k] = np.einsum("ij,ij->i", d, d)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(v)), best]


class VectorFile:
    """The full vectors, in buckets of their keys, and the compressed file, both in the shared folder."""

    def __init__(self, vectors: DataFrame, dimension: int, bits: int = BITS):
        """vectors: vec_id and v, integer arrays of `dimension`."""
        spark = vectors.sparkSession
        self.dimension, self.bits, self.spark = dimension, bits, spark
        numbered = cut(vectors.select(F.monotonically_increasing_id().alias("key"), "vec_id", "v"), "vectors")
        self.rows = numbered.count()
        self.path, self.name = scratch_dir(spark, "full"), f"verimill_{uuid.uuid4().hex}"
        numbered.write.bucketBy(max(4, self.rows // BUCKET_VECTORS), "key").option("path", self.path).saveAsTable(self.name)
        drop_cut(numbered)
        self.full = spark.table(self.name)
        self.edge = edge = edges(self.full, dimension, bits) if self.rows else np.zeros((dimension, 2), np.int64)

        def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rows = packed(cells_of(matrix(batch.column(1), dimension), edge), bits)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["key", "cells"])

        self.file = cut(self.full.select("key", "v").mapInArrow(compress, "key long, cells binary"), "cells")

    def drop(self) -> None:
        drop_cut(self.file)
        self.spark.sql(f"DROP TABLE {self.name}")
        delete(self.spark, self.path)

    def assign(self, centroids: np.ndarray) -> DataFrame:
        """(vec_id, cluster, distance) of every vector."""
        dimension, edge = self.dimension, self.edge

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = matrix(batch.column(1), dimension)
                    best, far = nearest(v, centroids, possible(cells_of(v, edge), edge, centroids))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

        return self.full.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")

    def to_fetch(self, before: np.ndarray, after: np.ndarray) -> DataFrame:
        """(key) of vectors that their cells don't show to stay in one cluster from the centroids `before` to those `after`."""
        dimension, bits, edge = self.dimension, self.bits, self.edge

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    data = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    cells = unpacked(data, dimension, bits)
                    a, b = possible(cells, edge, before), possible(cells, edge, after)
                    open_ = (a.sum(axis=1) > 1) | (b.sum(axis=1) > 1) | (a != b).any(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(open_))], ["key"])

        return self.file.mapInArrow(run, "key long")

    def sums(self, after: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums) of the clusters of the centroids `after`; with `before`, what they have more than those of `before`. Python integers."""
        dimension, edge, k = self.dimension, self.edge, len(after)
        rows = self.full.select("key", "v") if before is None else self.to_fetch(before, after).join(self.full.hint("merge"), "key").select("key", "v")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, dimension + 1), np.int64)  # the count stands behind the sums
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = matrix(batch.column(1), dimension)
                cells = cells_of(v, edge)
                one = np.concatenate([v, np.ones((len(v), 1), np.int64)], axis=1)
                for centroids, sign in ((after, 1), (before, -1)):
                    if centroids is not None:
                        of = nearest(v, centroids, possible(cells, edge, centroids))[0]
                        for c in range(k):
                            total[c] += sign * one[of == c].sum(axis=0)
            at = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total.ravel(), pa.int64())], ["cluster", "place", "n"])

        found = rows.mapInArrow(run, "cluster int, place int, n long").groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        total = np.zeros((k, dimension + 1), object)
        for r in found.collect():  # k times the dimension
            total[r["cluster"], r["place"]] = int(r["n"])
        return total[:, -1], total[:, :-1]


def first_centroids(vectors: DataFrame, k: int, seed: str = "3:") -> np.ndarray:
    """The vectors with the k smallest hashes of their ids, in that order; those without an id last, repeated ids by their components."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in vectors.orderBy(F.asc_nulls_last(digest), "v").limit(k).collect()], np.int64)


def cluster(file: VectorFile, centroids: np.ndarray, rounds: int = 10) -> np.ndarray:
    """The centroids after `rounds` rounds: every vector to the nearest, then each cluster that has any to floor(sum / count)."""
    counts, sums, before = None, None, None
    for _ in range(rounds):
        if before is not None and (before == centroids).all():
            break  # nothing moves any more
        n, s = file.sums(centroids, before)
        counts, sums = (n, s) if before is None else (counts + n, sums + s)
        before = centroids
        centroids = np.array([[x // n for x in row] if n else list(old) for n, row, old in zip(counts, sums, before, strict=True)], np.int64)
    return centroids


def op11_clustering(vectors: DataFrame, k: int = 8, rounds: int = 10, dimension: int = 64, bits: int = BITS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector of vectors (vec_id, embedding).

    Repeated rows are vectors of their own. With fewer than k vectors each starts a centroid; without any there is no row. Null arrays and
    those with a null, non-finite or missing component are left out, and so are components beyond LARGEST, see kept_vectors(); a null id stays.
    """
    file = VectorFile(kept_vectors(vectors, dimension), dimension, bits)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not file.rows:
        file.drop()
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = cluster(file, first_centroids(file.full, k), rounds)
    assigned = cut(file.assign(centroids), "assigned")
    file.drop()
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    of, total = {r["cluster"]: r["cluster_inertia"] for r in per}, sum(r["cluster_inertia"] for r in per)
    table = vectors.sparkSession.createDataFrame([(c, of.get(c, 0), total, d) for c, d in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = 10) -> str:
    far = "list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - c.v[i]) * (e.v[i] - c.v[i])))"
    parts = [
        "e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM e QUALIFY c < 8)",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(e.v) AS v, arg_min(c, (far, c)) AS c, min(far) AS far FROM (SELECT vec_id, e.v, c.c, {far} AS far FROM e, c{r} c) e GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, (s - ((s % n) + n) % n) // n AS x FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i)) GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.c = m.c)")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance, CAST(sum(far) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""


ORACLE = _oracle()
