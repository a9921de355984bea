"""Exact top-k inner products by norm-bucketed retrieval (LEMP: Teflioudi and Gemulla, 2015-2016)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_schema, small_batches, table, to_batch

NONE = -(1 << 62)  # stands for no score; its negative is a long too
BUCKET, QUERIES_AT_ONCE, SEEDS, FOCUS = 2048, 16_384, 4096, 4


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>, norm2 long) of the usable vectors: floor(scale * x); null, null or non-finite components drop out."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    out = vectors.where(usable).select("vec_id", v.alias("v"))
    return out.withColumn("norm2", F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products; by floats where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**52 else a @ b.T


class Best:
    """The k best (score, vec_id) of each query so far; a query's own row is never among them."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), NONE)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = floor if floor is not None else np.full(len(ids), NONE)

    def threshold(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, q: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        """Pairs of query row, vec_id and score."""
        ok = (self.ids[q] != vec) & (score >= self.floor[q]) & (score >= self.score[q, -1])
        q, vec, score = q[ok], vec[ok], score[ok]
        if not len(q):
            return
        rows = np.unique(q)
        q = np.concatenate([q, np.repeat(rows, self.k)])
        vec, score = np.concatenate([vec, self.vec[rows].ravel()]), np.concatenate([score, self.score[rows].ravel()])
        order = np.lexsort((vec, -score, q))
        q, vec, score = q[order], vec[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.vec[q[keep], rank[keep]], self.score[q[keep], rank[keep]] = vec[keep], score[keep]


def scan(best: Best, queries: np.ndarray, norms: np.ndarray, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> None:
    """One bucket: vectors of like length, sorted by falling length.

    A query's local cosine threshold is its score to beat over its length and the bucket's largest. Above 1 the
    bucket is skipped. Below 0.5 the bucket is pruned by length: only vectors at least as long as the score to
    beat over the query's length are multiplied. Else it is pruned by coordinates: the query's FOCUS largest
    coordinates and the lengths of both rests bound each product (Cauchy-Schwarz). What is left is verified by
    whole integer products. Bounds are loosened by a hair, so rounding drops nothing.
    """
    for a in range(0, len(queries), 256):
        q, n, t = queries[a : a + 256], norms[a : a + 256], best.threshold()[a : a + 256]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(n * lengths[0] > 0, t / (n * lengths[0]), np.where(t > 0, np.inf, -np.inf))
        by_length = np.flatnonzero(local < 0.5)
        by_coordinate = np.flatnonzero((local >= 0.5) & (local <= 1 + 1e-9))
        if len(by_length):
            reach = np.where(t[by_length] > 0, t[by_length] / np.maximum(n[by_length], 1e-300) * (1 - 1e-9), 0.0)
            some = int(np.searchsorted(-lengths, -reach.min(), side="right"))
            s = _exact(q[by_length], vectors[:some])
            i, j = np.nonzero(s >= t[by_length][:, None])
            best.add(a + by_length[i], ids[j], s[i, j])
        for i in by_coordinate.tolist():
            some = int(np.searchsorted(-lengths, -(t[i] / n[i] * (1 - 1e-9)), side="right"))
            focus = np.argsort(-np.abs(q[i]))[:FOCUS]
            part = vectors[:some][:, focus]
            rest_q = np.sqrt(max(float((q[i] ** 2).sum() - (q[i][focus] ** 2).sum()), 0.0))
            bound = part @ q[i][focus] + rest_q * np.sqrt(np.maximum(lengths[:some] ** 2 - (part**2).sum(1), 0)) * (1 + 1e-9) + 1e-6
            j = np.flatnonzero(bound >= t[i])
            if len(j):
                best.add(np.full(len(j), a + i), ids[j], _exact(q[i : i + 1], vectors[j])[0])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every` the k highest integer products with other rows.

    Ties go to the smaller vec_id; fewer than k others give fewer rows. Unusable vectors (see quantised) take no
    part; shorter vectors are filled up with zeros. Rows that repeat a vec_id
    are one query each and candidates to others, never to their own id; repeated rows give repeated results.

    Candidates are range-partitioned by falling length (vec_id splits equal ones) and read in buckets. Queries
    are the stated set; they are broadcast in blocks of QUERIES_AT_ONCE, whose size is bounded, one pass each. A
    block's scores to beat come from the SEEDS longest candidates first.
    """
    spark = vectors.sparkSession
    small_batches(spark, BUCKET)
    usable = table(quantised(vectors, scale), "vectors")
    sizes = usable.agg(F.max(F.size("v")).alias("n"), F.count(F.lit(1)).alias("count")).first()
    if sizes.n is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = usable.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(max(sizes.n, 1)) - F.size("v"))))
    parts = max(1, -(-sizes["count"] // (8 * BUCKET)))
    sorted_rows = table(rows.repartitionByRange(parts, F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id"), "buckets")
    seeds = sorted_rows.orderBy(F.desc("norm2"), "vec_id").limit(SEEDS).toArrow()
    seed_ids, seed_vectors = seeds.column("vec_id").to_numpy(), _matrix(seeds.column("v").combine_chunks())
    queries = table(rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").withColumn("block", F.lit(0)), "queries")
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    schema = "query_id long, vec_id long, score long, copy int"
    arrow = arrow_schema(schema)
    found = []
    for block in range(blocks):
        # blocks by a hash of the id: at most a little more than QUERIES_AT_ONCE each
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).select("vec_id", "v").toArrow()
        if not own.num_rows:
            continue
        ids, q = own.column("vec_id").to_numpy(), _matrix(own.column("v").combine_chunks())
        first = Best(ids, k)
        for a in range(0, len(ids), 512):
            s = _exact(q[a : a + 512], seed_vectors)
            s[ids[a : a + 512, None] == seed_ids[None, :]] = NONE
            if s.shape[1] >= k:
                first.floor[a : a + 512] = np.partition(s, -k, axis=1)[:, -k]
        shared = spark.sparkContext.broadcast((ids, q, first.floor))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, floor = shared.value
            best, norms = Best(ids, k, floor), np.sqrt((q.astype(np.float64) ** 2).sum(1))
            for b in batches:
                if b.num_rows:
                    norm2 = b.column(2).to_numpy()
                    order = np.argsort(-norm2, kind="stable")
                    scan(best, q, norms, b.column(0).to_numpy()[order], _matrix(b.column(1))[order], np.sqrt(norm2[order].astype(np.float64)))
            i, r = np.nonzero(best.score != NONE)
            if len(i):
                yield to_batch({"query_id": ids[i], "vec_id": best.vec[i, r], "score": best.score[i, r], "copy": i}, arrow)

        found.append(table(sorted_rows.select("vec_id", "v", "norm2").mapInArrow(search, schema), "found"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(W.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
