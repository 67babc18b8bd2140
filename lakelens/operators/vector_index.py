"""Approximate nearest vectors: coarse cells, product-quantised residuals, exact rescoring.

Cells and code books are learned by k-means from a bounded sample. Every vector
is indexed: its cell, and for each run of dimensions the nearest of 256
residuals. A query visits its nearest cells only; its products with all
residuals are looked up, so that a candidate costs a few table reads, and the
best of them are scored again from the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot, ranked
from ..functions.session import small, written
from ..functions.vectors import matrices

#: Vectors of the training sample, rounds of k-means, vectors of an index row, queries of a block.
SAMPLE, ROUNDS, ROW, BLOCK = 1 << 16, 12, 4096, 2048
CODES = 256


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centres of at most ``k`` groups; an empty group keeps its centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in slices."""
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Quantiser:
    """Cells, and the code book of each run of dimensions, in single precision: they choose candidates, scores come from the vectors."""

    cells: np.ndarray
    books: list[np.ndarray]
    runs: list[slice]

    @classmethod
    def learn(cls, x: np.ndarray, n_cells: int, n_runs: int) -> Quantiser:
        x = np.asarray(x, np.float32)
        cells = kmeans(x, n_cells)
        rest = x - cells[nearest(x, cells)]
        ends = np.linspace(0, x.shape[1], min(n_runs, x.shape[1]) + 1).astype(int)
        runs = [slice(a, b) for a, b in zip(ends, ends[1:])]
        return cls(cells, [kmeans(rest[:, r], CODES) for r in runs], runs)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.asarray(x, np.float32)
        at = nearest(x, self.cells)
        rest = x - self.cells[at]
        return at, np.stack([nearest(rest[:, r], b) for r, b in zip(self.runs, self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of queries with all residuals: query x run x code."""
        out = np.zeros((len(q), len(self.runs), CODES), np.float32)
        for j, (r, b) in enumerate(zip(self.runs, self.books)):
            out[:, j, : len(b)] = q[:, r] @ b.T
        return out

    def visited(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` cells of the highest product with each query."""
        return np.argsort(-(q @ self.cells.T), axis=1, kind="stable")[:, :probes]


def learned(vectors: DataFrame, n_cells: int, n_runs: int = 16, id_col: str = "vec_id") -> Quantiser:
    """A quantiser of a sample of at most about ``SAMPLE`` vectors, chosen by a hash of the id."""
    n = max(1, vectors.count())
    part = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / n) * (1 << 30)))
    rows = vectors.filter(part).select(id_col, "embedding").limit(2 * SAMPLE).toArrow().combine_chunks().sort_by(id_col)
    found = matrices(rows["embedding"].combine_chunks())
    if not found:
        raise ValueError("no vectors to learn from")
    return Quantiser.learn(max(found.values(), key=lambda x: len(x[1]))[1], n_cells, n_runs)


def indexed(vectors: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(cell, n, ids, codes): every vector of the quantiser's length, in rows of at most ``ROW`` of one cell, written once."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)  # size fixed by cells and code books

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qt = shared.value
        for b in batches:
            for dim, (at, rows) in matrices(b.column(1)).items():
                if dim == qt.cells.shape[1]:
                    cell, codes = qt.encode(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0).take(pa.array(at)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "id", "code"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, z in zip(cuts, cuts[1:]):
                for x in range(a, z, ROW):
                    part = b.slice(x, min(ROW, z - x))
                    cells = [int(cell[x]), part.num_rows, part.column(1).to_numpy().tobytes(), b"".join(part.column(2).to_pylist())]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["cell", "n", "ids", "codes"])

    rows = vectors.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), "embedding").mapInArrow(encode, "cell int, id long, code binary")
    # a cell may hold any share of the vectors, so it is dealt by id as well
    rows = rows.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell", "id")
    return written(rows.mapInArrow(pack, "cell int, n int, ids binary, codes binary"), "vector-index")


def candidate_share(index: DataFrame, queries: DataFrame, quantiser: Quantiser, probes: int) -> DataFrame:
    """(pairs, share): pairs of queries and vectors that a search scores, and their share of all."""
    seen = _visits(queries, quantiser, probes)
    sizes = index.groupBy("cell").agg(F.sum("n").alias("n"))  # a row a cell
    total, n = index.agg(F.sum("n").alias("total")), queries.agg(F.count("*").alias("queries"))
    pairs = seen.groupBy("cell").agg(F.count("*").alias("q")).join(F.broadcast(sizes), "cell").agg(F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0)).alias("pairs"))
    return pairs.join(F.broadcast(total)).join(F.broadcast(n)).select("pairs", (F.col("pairs") / (F.col("total") * F.col("queries"))).alias("share"))


def _visits(queries: DataFrame, quantiser: Quantiser, probes: int) -> DataFrame:
    kind = queries.schema["query_id"].dataType.simpleString()
    shared = queries.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, (at, rows) in matrices(b.column(1)).items():
                if dim == shared.value.cells.shape[1]:
                    cells = shared.value.visited(rows, probes)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(at, cells.shape[1]))), pa.array(cells.ravel(), pa.int32())], names=["query_id", "cell"])

    return queries.select("query_id", "qv").mapInArrow(run, f"query_id {kind}, cell int")


def search(index: DataFrame, vectors: DataFrame, queries: DataFrame, quantiser: Quantiser, k: int, probes: int, rescored: int | None = None) -> DataFrame:
    """(query_id, vec_id, score): about the ``k`` highest inner products of each query (query_id, qv), ties to the smaller vec_id.

    The ``rescored`` best candidates (10 k) by looked-up products are scored
    exactly. Queries go to the tasks in blocks; a task keeps ``rescored`` rows a query of a block.
    """
    keep = rescored or 10 * k
    n_blocks = max(1, -(-queries.count() // BLOCK))
    kind = queries.schema["query_id"].dataType.simpleString()
    out = None
    for i in range(n_blocks):
        block = queries.select("query_id", "qv").filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i).toArrow().combine_chunks()
        part = index.mapInArrow(_lookup(block, quantiser, probes, keep), f"query_id {kind}, vec_id long, about float")
        part = part.withColumn("r", ranked("query_id", F.desc("about"), "vec_id")).filter(F.col("r") <= keep).select("query_id", "vec_id")
        part = written(part, "candidates") if n_blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    rows = vectors.select("vec_id", "embedding").join(small(out, 1_000_000), "vec_id").join(small(queries.select("query_id", "qv"), 100_000), "query_id")
    score = rows.select("query_id", "vec_id", dot(F.col("embedding"), F.col("qv")).alias("score"))
    return score.withColumn("r", ranked("query_id", F.desc("score"), "vec_id")).filter(F.col("r") <= k).drop("r")


def _lookup(block: pa.Table, quantiser: Quantiser, probes: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = block["query_id"].combine_chunks()
        at, q = matrices(block["qv"].combine_chunks()).get(quantiser.cells.shape[1], (np.zeros(0, np.int64), np.zeros((0, quantiser.cells.shape[1]))))
        tables, centre, cells = quantiser.tables(q), q @ quantiser.cells.T, quantiser.visited(q, probes)
        best = [(np.zeros(0, np.float32), np.zeros(0, np.int64))] * len(q)
        runs = np.arange(len(quantiser.runs))
        for b in batches:
            for cell, ids, codes in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                codes = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
                for n in np.flatnonzero((cells == cell).any(axis=1)):
                    about = np.float32(centre[n, cell]) + tables[n][runs, codes].sum(axis=1)
                    s, i = np.concatenate([best[n][0], about]), np.concatenate([best[n][1], ids])
                    order = np.lexsort((i, -s))[:keep]
                    best[n] = s[order], i[order]
        for n, (s, i) in enumerate(best):
            if len(i):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(i), at[n]))), pa.array(i), pa.array(s, pa.float32())], names=["query_id", "vec_id", "about"])

    return run
