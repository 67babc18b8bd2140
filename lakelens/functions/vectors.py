"""Nearest vectors by blocked matrix products over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import ranked
from .session import written

#: Vectors multiplied at a time with a block of queries or centres.
ROWS = 512


def matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: their places in the column and their rows; vectors that are null or hold null or non-finite parts are left out."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out = {}
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        rows = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
        fit = np.isfinite(rows).all(axis=1)
        out[dim] = at[fit], rows[fit]
    return out


def _blocks(df: DataFrame, key: str, size: int) -> Iterator[tuple[pa.Table, bool]]:
    """Blocks of about ``size`` rows, dealt by hash and fetched one at a time, and whether there are several."""
    n = max(1, -(-df.count() // size))
    for i in range(n):
        yield (df if n == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)).toArrow().combine_chunks(), n > 1


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table[name]
    return c.chunk(0) if c.num_chunks else pa.array([], c.type)


class _Best:
    """The best ``k`` vectors so far of each query of one length: highest score, then smallest id."""

    def __init__(self, queries: np.ndarray, k: int, least: float):
        self.k = k
        self.edge = np.full(len(queries), least)
        self.held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)

    def add(self, scores: np.ndarray, ids: np.ndarray, files: np.ndarray) -> None:
        """Scores of each query with some vectors; -inf where they do not meet."""
        open_ = scores >= self.edge[:, None]
        for q in np.flatnonzero(open_.any(axis=1)):
            at = np.flatnonzero(open_[q])
            s, i, f = (np.concatenate(x) for x in zip(self.held[q], (scores[q, at], ids[at], files[at])))
            order = np.lexsort((i, -s))[: self.k]
            self.held[q] = s[order], i[order], f[order]
            if len(order) == self.k:
                self.edge[q] = s[order[-1]]


class _Buckets:
    """Queries of one length by table and bucket; scores of vectors with those of their own buckets."""

    def __init__(self, queries: np.ndarray, codes: Callable[[np.ndarray], np.ndarray]):
        self.queries, self.codes = queries, codes
        self.at = [{b: np.flatnonzero(c == b) for b in np.unique(c).tolist()} for c in codes(queries).T]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = np.full((len(self.queries), len(rows)), -np.inf)
        for at, codes in zip(self.at, self.codes(rows).T):
            for b in set(np.unique(codes).tolist()) & at.keys():
                met = np.flatnonzero(codes == b)
                out[np.ix_(at[b], met)] = self.queries[at[b]] @ rows[met].T
        return out


def nearest_rows(vectors: DataFrame, queries: DataFrame, k: int, least: float, query_block: int, codes: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, vec_id, file_id, score): the ``k`` highest inner products of each query, at or above ``least``; ties to the smaller vec_id.

    Queries go to every task in blocks of about ``query_block``; a task holds k rows a query of a block. With
    ``codes`` (rows -> a bucket a table) a vector meets only the queries that share a bucket with it in some table.
    """
    src = vectors.select(F.col("vec_id").cast("long"), F.col("file_id").cast("long"), "embedding")
    kind = queries.schema["query_id"].dataType.simpleString()
    out = None
    for table, several in _blocks(queries.select("query_id", "qv"), "query_id", query_block):
        part = src.mapInArrow(_nearest(table, k, least, codes), f"query_id {kind}, vec_id long, file_id long, score double")
        part = part.withColumn("r", ranked("query_id", F.desc("score"), "vec_id")).filter(F.col("r") <= k).drop("r")
        part = written(part, "nearest") if several else part  # the driver then lets go of the block
        out = part if out is None else out.unionByName(part)
    return out


def _nearest(table: pa.Table, k: int, least: float, codes: Callable[[np.ndarray], np.ndarray] | None):
    names = _column(table, "query_id")

    def run(batches):
        queries = matrices(_column(table, "qv"))
        best = {dim: (at, _Best(rows, k, least)) for dim, (at, rows) in queries.items()}
        scores = {dim: _Buckets(rows, codes).scores if codes else lambda x, rows=rows: rows @ x.T for dim, (_, rows) in queries.items()}
        for b in batches:
            ids, files = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in (0, 1))
            for dim, (at, rows) in matrices(b.column(2)).items():
                for x in range(0, len(rows) if dim in best else 0, ROWS):
                    part = slice(x, x + ROWS)
                    best[dim][1].add(scores[dim](rows[part]), ids[at[part]], files[at[part]])
        for at, found in best.values():
            for q, (s, i, f) in zip(at, found.held):
                if len(s):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(s), q))), pa.array(i), pa.array(f), pa.array(s)], names=["query_id", "vec_id", "file_id", "score"])

    return run


def nearest_centre(vectors: DataFrame, centres: DataFrame, block: int, least: float | None = None, ordered: bool = False) -> DataFrame:
    """(vec_id, identity, score): each vector's centre (identity, c) of the highest inner product, if that reaches ``least``.

    Ties go to the smaller identity. With ``ordered`` a centre is that of a
    cluster led by the vector ``identity``: only vectors of a larger id see
    it, and ties go to the larger identity. Centres go to every task in blocks of about
    ``block``, one at a time; a vector that no centre fits gives no row.
    """
    src = vectors.select(F.col("vec_id").cast("long"), "embedding")
    kind = centres.schema["identity"].dataType.simpleString()
    out = None
    for table, several in _blocks(centres.select("identity", "c"), "identity", block):
        part = src.mapInArrow(_centre(table, least, ordered), f"vec_id long, identity {kind}, score double")
        if not several:
            return part
        part = written(part, "nearest")
        out = part if out is None else out.unionByName(part)
    best = ranked("vec_id", F.desc("score"), F.desc("identity") if ordered else F.asc("identity"))
    return out.withColumn("r", best).filter("r = 1").drop("r")


def _centre(table: pa.Table, least: float | None, ordered: bool):
    table = table.sort_by([("identity", "descending" if ordered else "ascending")]).combine_chunks()
    names = _column(table, "identity")

    def run(batches):
        centres = matrices(_column(table, "c"))
        for b in batches:
            for dim, (at, rows) in matrices(b.column(1)).items():
                if dim not in centres or not len(centres[dim][0]):
                    continue
                own, c = centres[dim]
                first = names.take(pa.array(own)).to_numpy(zero_copy_only=False) if ordered else None
                ids = b.column(0).to_numpy(zero_copy_only=False)[at]
                for x in range(0, len(rows), ROWS):
                    scores = rows[x : x + ROWS] @ c.T
                    if ordered:
                        scores[ids[x : x + ROWS, None] <= first[None, :]] = -np.inf
                    k = scores.argmax(axis=1)
                    best = scores[np.arange(len(k)), k]
                    fit = np.flatnonzero((best > -np.inf) & (best >= (-np.inf if least is None else least)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x : x + ROWS][fit]), names.take(pa.array(own[k[fit]])), pa.array(best[fit])], names=["vec_id", "identity", "score"])

    return run
