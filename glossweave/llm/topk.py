"""Operator 8: exact top-k by inner product of integer vectors, pruned by segment statistics from coarse to fine.

Inner product, squared norms and distance bound each other; here the bound is kept on the score itself: over a segment of
m components with means a, b and deviations s, t (Euclidean norms of what the means leave), the product is at most
m*a*b + s*t. Levels halve the segments' length; at each, candidates whose bound stays under the query's k-th score found
so far are dropped, and the survivors' products are computed exactly. Queries come in blocks of bounded size, each of
which is held against all vectors and let go once its rows are written; every task keeps at most k rows a query, so equal
vectors do not add up anywhere.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossweave.functions.session import importable, shared_dir

#: Queries that go to the executors at once.
BLOCK = 4096
#: Segments a vector at each level, where its length allows.
LEVELS = (4, 16)
#: Vectors compared with all queries at once.
ROWS = 512


def integers(column: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their floor(scale * x)); null vectors and those with a null or non-finite component don't."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = ~column.is_null().to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
    size = np.diff(at)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    valid &= bad[at[1:]] == bad[at[:-1]]
    rows = np.flatnonzero(valid)
    if not len(rows):
        return rows, np.zeros((0, 0))
    width = int(size[rows].max())
    take = at[rows][:, None] + np.arange(width)[None, :]
    return rows, np.floor(scale * values[take]) if width else np.zeros((len(rows), 0))


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(sqrt(m) * mean, deviation norm) of each segment of each vector."""
    parts = np.array_split(np.arange(x.shape[1]), segments)
    sums = np.stack([x[:, p].sum(axis=1) / np.sqrt(len(p)) for p in parts], axis=1)
    squares = np.stack([(x[:, p] ** 2).sum(axis=1) for p in parts], axis=1)
    return sums, np.sqrt(np.maximum(0, squares - sums**2))


class Queries:
    """A block of queries with their segment statistics and the scores that are to be beaten."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = [(n, *statistics(vectors, n)) for n in LEVELS if n <= vectors.shape[1]]
        # the block's own vectors are candidates too: the k-th best of them is a floor of the true k-th score
        self.floor = np.full(len(ids), -np.inf)
        if len(ids) > k:
            for i in range(0, len(ids), ROWS):
                score = vectors[i : i + ROWS] @ vectors.T
                score[np.arange(len(score)), np.arange(i, i + len(score))] = -np.inf
                self.floor[i : i + ROWS] = np.partition(score, -k, axis=1)[:, -k]

    def best(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate row, score) of all pairs at or above the floor."""
        alive = np.ones((len(self.ids), len(x)), bool)
        for n, mean, dev in self.levels:
            m, d = statistics(x, n)
            bound = mean @ m.T + dev @ d.T
            alive &= bound >= (floor - 1e-6 * (1 + np.abs(floor)))[:, None]
            share = alive.mean()
            if share < 0.02:
                break
        alive &= self.ids[:, None] != ids[None, :]
        q, c = np.nonzero(alive)
        if len(q) * 8 < alive.size:
            score = np.concatenate([np.einsum("ij,ij->i", self.vectors[q[i : i + 65536]], x[c[i : i + 65536]]) for i in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
        else:
            score = (self.vectors @ x.T)[q, c]
        keep = score >= floor[q]
        return q[keep], c[keep], score[keep]


def top(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The rows of each query's k best, ties to the smaller id, by query and rank."""
    order = np.lexsort((ids, -score, q))
    first = np.searchsorted(q[order], q[order])
    return order[np.arange(len(order)) - first < k]


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each row whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id and embedding; other columns are left out. Rows with a null vec_id, a null vector, or a null
    or infinite component take no part. A candidate is every row with another vec_id; rows that repeat a vec_id are
    candidates each (and, as queries, answer as one, by the first in order of rows of their length). A vector of another
    length than a query's is no candidate of it. Fewer candidates give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    importable(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    sizes = {r["size"]: r["n"] for r in asked.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).collect()}  # one a length
    blocks = [(size, n, max(1, -(-n // (block // 2 or 1)) if n > block else 1)) for size, n in sorted(sizes.items())]
    schema = "query_id long, vec_id long, score long"
    out = f"{shared_dir(spark)}/best-{uuid.uuid4().hex}" if sum(b for _, _, b in blocks) > 1 else None
    found = None
    for size, _, n_blocks in blocks:
        for b in range(n_blocks):
            part = asked.where(F.size("embedding") == size)
            here = (part if n_blocks == 1 else part.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b)).toArrow()
            use, x = integers(here["embedding"], scale)
            ids, at = np.unique(here["vec_id"].to_numpy()[use], return_index=True)
            if not len(ids):
                continue
            found = _against(rows.where(F.size("embedding") == size), Queries(ids, x[at], k), scale)
            if out:  # written, so that a block's vectors leave the driver and the plan
                found.write.mode("append").parquet(out)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if out:
        found = spark.read.schema(schema).parquet(out)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _against(rows: DataFrame, queries: Queries, scale: float) -> DataFrame:
    k = queries.k

    def scan(batches):
        floor = queries.floor.copy()
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            use, x = integers(batch.column(1), scale)
            own = batch.column(0).to_numpy()[use]
            for i in range(0, len(own), ROWS):
                q, c, s = queries.best(own[i : i + ROWS], x[i : i + ROWS], floor)
                held = tuple(np.concatenate(z) for z in zip(held, (q, own[i : i + ROWS][c], s), strict=True))
                if len(held[0]) > 4 * k * len(queries.ids):
                    held = _cut(held, k, floor)
        q, c, s = _cut(held, k, floor)
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), pa.array(c), pa.array(s.astype(np.int64))], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(scan, "query_id long, vec_id long, score long")


def _cut(held: tuple, k: int, floor: np.ndarray) -> tuple:
    """Only each query's k best; raises the floor of those that have k."""
    keep = top(*held, k)
    q, c, s = (z[keep] for z in held)
    n = np.bincount(q, minlength=len(floor))
    full = np.flatnonzero(n >= k)
    last = np.cumsum(n)[full] - 1
    floor[full] = np.maximum(floor[full], s[last])
    return q, c, s
