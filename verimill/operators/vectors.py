"""A trained vector index: inverted lists by centroid, product-quantised codes of what is left, exact distances for the best.

Centroids and codebooks are fitted on a bounded sample; every vector is indexed. Lists are stored in parts of bounded size, so that a centroid
that very many vectors are near is no single task. A batch of queries meets only the parts of the lists it probes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot, norm
from .retrieval import ranked

#: Vectors that the centroids and codebooks are fitted on, at most.
SAMPLE = 50_000
#: Vectors of a part of a list, about; queries of a batch that a part meets at a time.
PART_ROWS, QUERY_ROWS = 20_000, 2_000


@dataclass
class Model:
    """centroids: unit vectors; codes[s, k]: the k-th entry of the codebook of the s-th slice of dimensions; usual: lists that a query probes."""

    centroids: np.ndarray
    codes: np.ndarray
    usual: int

    def probes(self, v: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row."""
        near = v @ self.centroids.T
        return np.argsort(-near, axis=1, kind="stable")[:, :n]

    def encode(self, v: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = (v - self.centroids[lists]).reshape(len(v), len(self.codes), -1)
        out = np.empty(rest.shape[:2], np.uint8)
        for s, book in enumerate(self.codes):
            out[:, s] = nearest(rest[:, s], book)
        return out


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero vectors stay."""
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(n > 0, n, 1)


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * v @ centres.T).argmin(axis=1)


def means(v: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; a centre that nothing is near stays."""
    centres = v[rng.choice(len(v), min(k, len(v)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(v, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, v)
        count = np.bincount(own, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def usual_probes(v: np.ndarray, tenant: np.ndarray, centroids: np.ndarray, target: float, k: int = 10, asked: int = 400) -> int:
    """The fewest lists to probe so that the lists of a share `target` of the k nearest neighbours, inside their tenants, are among them."""
    own, q = nearest(v, centroids), v[:asked]
    near = np.where(tenant[:asked, None] == tenant[None], q @ v.T, -np.inf)
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    at = np.argsort(-near, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, own[at], axis=1)[np.isfinite(np.take_along_axis(near, at, axis=1))]
    return int(np.quantile(needed, target)) + 1 if len(needed) else 1


def train(vectors: DataFrame, lists: int = 0, slices: int = 16, entries: int = 256, seed: int = 7, rounds: int = 10, sample: int = SAMPLE, target: float = 0.98) -> Model:
    """A model of vectors (tenant_id, document_id, embedding), fitted on those with the `sample` smallest hashes of their ids. lists: 0 takes the
    root of the number of vectors, up to a 32nd of the sample. The dimension is a multiple of `slices`. How many lists a query is to probe
    follows from the sample too, see usual_probes(): where vectors have no clusters, that is most lists, and codes alone save work."""
    rows = vectors.orderBy(F.xxhash64("document_id"), "document_id").limit(sample).select("tenant_id", "embedding").toArrow()
    if not rows.num_rows:
        raise ValueError("there is no vector to fit an index on")
    v = unit(np.array(rows["embedding"].to_pylist(), float))
    lists = lists or max(1, min(int(vectors.count() ** 0.5), len(v) // 32))
    rng = np.random.default_rng(seed)
    centroids = unit(means(v, lists, rounds, rng))
    rest = (v - centroids[nearest(v, centroids)]).reshape(len(v), slices, -1)
    books = [means(rest[:, s], entries, rounds, rng) for s in range(slices)]
    return Model(centroids, np.stack(books), usual_probes(v, rows["tenant_id"].to_numpy(), centroids, target))


def build(vectors: DataFrame, model: Model, part_rows: int = PART_ROWS) -> DataFrame:
    """The index (list, part, tenant_id, document_id, code) of vectors (tenant_id, document_id, embedding), to be stored partitioned by list.

    Lists are counted, and one of more than part_rows vectors is dealt to parts by the hash of the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = unit(np.array(batch.column(2).to_pylist(), float))
                own = model.probes(v, 1)[:, 0]
                codes = [x.tobytes() for x in model.encode(v, own)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0), batch.column(1), pa.array(codes, pa.binary())], ["list", "tenant_id", "document_id", "code"])

    coded = vectors.select("tenant_id", F.col("document_id").cast("long").alias("document_id"), "embedding").mapInArrow(run, "list int, tenant_id long, document_id long, code binary")
    sizes = coded.groupBy("list").agg(F.count("*").alias("n")).collect()  # one row a list
    parts = F.create_map(*[F.lit(x) for r in sizes for x in (r["list"], -(-r["n"] // part_rows))]) if sizes else F.create_map().cast("map<int,int>")
    return coded.withColumn("part", F.pmod(F.xxhash64("document_id"), parts[F.col("list")]).cast("int"))


def candidates(index: DataFrame, model: Model, queries: DataFrame, probes: int, most: int) -> DataFrame:
    """(query_id, document_id, near): of each query's tenant the `most` vectors that the codes put nearest, in the lists of its nearest centroids."""
    parts = index.groupBy("list").agg(F.max("part").alias("last"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = unit(np.array(batch.column(2).to_pylist(), float))
                lists = model.probes(v, probes)
                at = np.repeat(np.arange(len(v)), lists.shape[1])
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel(), pa.int32()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(list(v[at]), pa.list_(pa.float64()))], ["list", "query_id", "tenant_id", "q"])

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("tenant_id").cast("long").alias("tenant_id"), "embedding").mapInArrow(probe, "list int, query_id long, tenant_id long, q array<double>")
    asked = asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), "last")).alias("part"), "query_id", "tenant_id", "q")

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "document_id", "near"]
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if left.num_rows and right.num_rows:
            codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
            ids, of = (left[c].to_numpy() for c in ("document_id", "tenant_id"))
            tenant, query = (right[c].to_numpy() for c in ("tenant_id", "query_id"))
            centre, found = model.centroids[key[0].as_py()], []
            for own in np.unique(tenant):
                rows = np.flatnonzero(of == own)
                asking = np.flatnonzero(tenant == own)
                for at in range(0, len(asking) if len(rows) else 0, QUERY_ROWS):
                    mine = asking[at : at + QUERY_ROWS]
                    q = np.array(right["q"].take(pa.array(mine)).to_pylist())
                    # q . v is q . centre and what the codes add to it, looked up by slice
                    table = np.einsum("qsd,sed->qse", q.reshape(len(q), len(model.codes), -1), model.codes)
                    near = np.repeat((q @ centre)[:, None], len(rows), axis=1)
                    for s in range(codes.shape[1]):
                        near += table[:, s, codes[rows, s]]
                    k = min(most, len(rows))
                    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    found.append((np.repeat(query[mine], k), ids[rows[top]].ravel(), np.take_along_axis(near, top, axis=1).ravel()))
            if found:
                out = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=names)

    met = index.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInArrow(meet, "query_id long, document_id long, near double")
    return ranked(met, ["query_id"], F.desc("near"), F.asc("document_id"), most=most).drop("rank")


def search(index: DataFrame, model: Model, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int = 0, rerank: int = 0) -> DataFrame:
    """(query_id, document_id, distance, rank): the k nearest vectors by cosine for queries (query_id, tenant_id, embedding) among their tenant's.

    The codes propose `rerank` vectors (0: twenty times k) from `probes` lists (0: as many as training found usual); their exact distances decide. Zero vectors are
    at distance 1 of everything.
    """
    found = candidates(index, model, queries, probes or model.usual, rerank or 20 * k).select("query_id", "document_id")
    q = queries.select("query_id", F.col("embedding").alias("__q"))
    met = found.join(vectors.select("document_id", "embedding"), "document_id").join(q, "query_id")
    n = norm(F.col("embedding")) * norm(F.col("__q"))
    far = met.select("query_id", "document_id", F.round(1 - F.when(n > 0, dot(F.col("embedding"), F.col("__q")) / n).otherwise(0.0), 6).alias("distance"))
    return ranked(far, ["query_id"], F.asc("distance"), F.asc("document_id"), most=k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, wanted, found, recall) of ranked lists (query_id, document_id) against the exact ones."""
    both = exact.select("query_id", "document_id").join(found.select("query_id", "document_id").withColumn("hit", F.lit(1)), ["query_id", "document_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 4))
