"""Exact top-k by inner product through refined global score histograms.

Queries are taken in blocks of bounded size. Each pass scores a block against
every candidate and histograms the scores of each query inside the interval
that still holds its k-th score; summed over all tasks, the histogram tells
which bin that is. Integer scores make the interval a single value after a few
passes. A last pass keeps what lies above it and breaks ties by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, saved, slices

#: Queries a block (what is broadcast at once), bins a pass, candidates scored at once.
BLOCK, BINS, ROWS = 2048, 4096, 1024
#: Integer products up to here are exact in doubles.
EXACT = 2**53


def quantised(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of every usable vector.

    Vectors that are null or empty, hold a null or a non-finite component, or
    have a null id take no part; other columns, whatever their names, are ignored.
    """
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))
    return rows.filter(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(col: pa.ListArray, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products; by doubles where these are exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < EXACT:
        return (c.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64)
    return c.astype(np.int64) @ q.astype(np.int64).T


def _batches(batches, ids: np.ndarray, q: np.ndarray):
    """Candidate ids, scores (candidates x queries) and a mask of the queries' own rows."""
    for b in slices(batches, ROWS):
        if b.num_rows:
            cid = b.column(0).to_numpy(zero_copy_only=False)
            yield cid, _scores(q, _matrix(b.column(1), q.shape[1])), cid[:, None] == ids[None, :]


def _histogram(cands: DataFrame, shared, k: int) -> dict[int, list[tuple[int, int]]]:
    """Per query, (bin, count) from the highest bin down, summed over all tasks.

    A task sends only its highest bins up to its own k-th score: lower ones
    cannot hold the k-th of all. That is at most k rows a query and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, low, width = shared.value
        count = np.zeros((len(ids), BINS + 1), np.int64)
        row = np.arange(len(ids))[None, :] * (BINS + 1)
        for _, s, own in _batches(batches, ids, q):
            at = (s - low) // width
            inside = (at >= 0) & ~own  # what lies above the interval goes to the last bin
            count += np.bincount((row + np.minimum(at, BINS))[inside], minlength=count.size).reshape(count.shape)
        above = np.cumsum(count[:, ::-1], axis=1)[:, ::-1] - count
        n, bins = np.nonzero((count > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(bins, pa.int32()), pa.array(count[n, bins], pa.int64())], names=["q", "bin", "n"])

    rows = cands.mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("above", F.coalesce(F.sum("n").over(w), F.lit(0))).filter(F.col("above") < k)
    out: dict[int, list[tuple[int, int]]] = {}
    for r in rows.collect():  # at most k rows a query of this block
        out.setdefault(r["q"], []).append((r["bin"], r["n"]))
    return {q: sorted(x, reverse=True) for q, x in out.items()}


def _block(cands: DataFrame, ids: np.ndarray, q: np.ndarray, reach: int, k: int) -> DataFrame:
    """The block's result: (query_id, vec_id, score) above or at each query's k-th score, ties cut locally."""
    spark = cands.sparkSession
    bound = np.maximum(1, np.ceil(np.sqrt((q.astype(float) ** 2).sum(1)) * np.sqrt(float(reach)))).astype(np.int64) + 1
    low, width = -bound, np.maximum(1, -(-(2 * bound + 1) // BINS))
    while True:
        shared = spark.sparkContext.broadcast((ids, q, low, width))  # BLOCK vectors at most
        found = _histogram(cands, shared, k)
        kth = low.copy()
        for i in range(len(ids)):
            above = 0
            for at, n in found.get(i, []):
                above += n
                if above >= k:
                    kth[i] = low[i] + at * width[i]
                    break
        if (width == 1).all():
            break
        low, width = kth, np.maximum(1, -(-width // BINS))
    shared = spark.sparkContext.broadcast((ids, q, kth, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, kth, k = shared.value
        best: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(ids)
        for cid, s, own in _batches(batches, ids, q):
            hit = (s >= kth[None, :]) & ~own
            for i in np.flatnonzero(hit.any(axis=0)):
                at = hit[:, i]
                rows = np.vstack([best[i], np.column_stack([s[at, i], cid[at]])])
                best[i] = rows[np.lexsort((rows[:, 1], -rows[:, 0]))[:k]]
        n = np.repeat(np.arange(len(ids)), [len(x) for x in best])
        rows = np.vstack(best) if best else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[n], pa.int64()), pa.array(rows[:, 1], pa.int64()), pa.array(rows[:, 0], pa.int64())], names=["query_id", "vec_id", "score"])

    return cands.mapInArrow(run, "query_id long, vec_id long, score long")


def search(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` highest inner products of every query (all, if fewer): query_id, rank, vec_id, score.

    Both sides have ``vec_id long`` and ``v array<bigint>`` as ``quantised``
    makes them. A query never finds rows with its own id; queries that repeat an
    id count once; candidates that repeat a row each count. Ties go to the
    smaller vec_id. Vectors are compared with those of their own length only.
    Empty tables give an empty result.
    """
    spark = queries.sparkSession
    importable(spark)
    parts = []
    reaches = {r["d"]: r["m"] for r in candidates.groupBy(F.size("v").alias("d")).agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("m")).collect()}
    queries = queries.dropDuplicates(["vec_id"])
    for dim, reach in sorted(reaches.items()):
        mine = queries.filter(F.size("v") == dim)
        cands = candidates.filter(F.size("v") == dim)
        total = mine.count()
        n_blocks = max(1, -(-total // BLOCK))
        # a hash deals the queries over blocks of about BLOCK rows; each is broadcast on its own
        block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))
        for i in range(n_blocks if total else 0):
            rows = mine.filter(block == i).toArrow().to_pandas()
            if len(rows):
                part = _block(cands, rows["vec_id"].to_numpy(np.int64), np.vstack(rows["v"].to_list()).astype(np.int64), reach, k)
                parts.append(saved(part, "topk") if n_blocks > 1 else part)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
