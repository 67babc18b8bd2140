"""Near duplicates among embeddings by PCA-ordered tiled comparison.

Equal vectors are one node with a weight. Nodes are rotated to the principal
axes, largest variance first, and cut into tiles that lie close on the leading
axes. Two tiles are compared unless the boxes around them are too far apart:
the product over the leading axes plus the product of the norms of what
is left bounds the cosine; pairs that cannot reach the threshold end there, and
the others go on axis range by axis range. Pairs that reach it are scored again
from the vectors as given, in doubles. A task counts links and unites their
ends, so that it returns a row a node, never a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, find, importable, saved, slices, unite
from .jaccard_join import components

#: Nodes a tile, and values of a block of tiles (what is broadcast at once).
TILE, BLOCK_VALUES = 2048, 1 << 22
#: Values of the sample that fits the axes; they only order the work, so any sample gives the same links.
SAMPLE_VALUES = 1 << 21
#: Shares of all variance left beyond an axis range: the last one is none.
LEFT = (0.75, 0.5, 0.25)
#: Room for rounding in bounds, which are of single precision.
SLACK = 1e-4
#: A group of so large a share of all rows is joined by broadcast: there are at most as many of them.
HEAVY = 1000
_TILE = "tile long, dim int, n int, x binary, kind string, m binary, low binary, k binary, box binary"


def keyed(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x, k1, k2): the vector of a row that takes part, null in others, and two hashes of it."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    x = F.when(ok, F.transform(v, lambda x: F.when(x == 0, F.lit(0).cast(v_type(rows, vec_col))).otherwise(x)))  # no negative zeros
    out = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    return out.select("id", "x", *(F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(seed), "x")).alias(k) for k, seed in (("k1", 1), ("k2", 2))))


def v_type(rows: DataFrame, vec_col: str) -> str:
    return rows.schema[vec_col].dataType.elementType.simpleString()


def _matrix(x: pa.Array, dim: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows over their length, in doubles, whatever their scale."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Axes:
    """Principal axes of a dimension's vectors (not centred: cosines are kept), and where their ranges end."""

    def __init__(self, sample: np.ndarray):
        values, vectors = np.linalg.eigh(sample.T @ sample / max(1, len(sample)))
        self.v = np.ascontiguousarray(vectors[:, ::-1])
        share = np.maximum(values[::-1], 0)
        self.spread = np.sqrt(share) + 1e-12
        left = 1 - np.cumsum(share) / max(share.sum(), 1e-300)
        d = len(share)
        self.cuts = sorted({min(d, int(np.argmax(left <= x)) + 1) for x in LEFT if (left <= x).any()} | {d})

    def place(self, y: np.ndarray) -> np.ndarray:
        """A number that is close for vectors that lie close on the leading axes: their bins' bits in turn."""
        m = min(12, y.shape[1])
        bins = np.clip((y[:, :m] / self.spread[:m] + 2) * 4, 0, 15).astype(np.int64)
        out = np.zeros(len(y), np.int64)
        for bit in (3, 2, 1, 0):
            for k in range(m):
                out = out << 1 | bins[:, k] >> bit & 1
        return out


class Tile:
    """Nodes of a tile: vectors, weights, coordinates, and for each axis range the norms of what is left beyond it."""

    def __init__(self, row: dict, axes: Axes):
        self.number, dim = row["tile"], row["dim"]
        self.m = np.frombuffer(row["m"], np.int64)
        self.low = np.frombuffer(row["low"], np.int64)
        self.unit = _units(np.frombuffer(row["x"], row["kind"]).reshape(-1, dim))
        y = self.unit @ axes.v
        square = np.concatenate([np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(y), 1))], axis=1)
        self.rest = {c: np.sqrt(np.maximum(square[:, c], 0)).astype(np.float32) for c in axes.cuts}
        self.y = y.astype(np.float32)
        self.box = np.frombuffer(row["box"], np.float32).reshape(2, dim)


def linked(a: Tile, b: Tile, axes: Axes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in a, place in b) whose cosine reaches the threshold; of one tile, each pair once."""
    gap = np.maximum(0, np.maximum(a.box[0] - b.box[1], b.box[0] - a.box[1]))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if (gap.astype(float) ** 2).sum() > 2 - 2 * threshold + SLACK:
        return none
    least, start = np.float32(threshold - SLACK), 0
    score = np.zeros((len(a.y), len(b.y)), np.float32)
    pairs = None
    for cut in axes.cuts:
        r = slice(start, cut)
        start = cut
        if pairs is None:
            score += a.y[:, r] @ b.y[:, r].T
            open_ = score + np.multiply.outer(a.rest[cut], b.rest[cut]) >= least
            if a.number == b.number:
                open_ = np.triu(open_, 1)
            n = np.count_nonzero(open_)
            if not n:
                return none
            if 8 * n <= open_.size or cut == axes.cuts[-1]:
                pairs = np.nonzero(open_)
                score = score[pairs]
        else:
            i, j = pairs
            for at in range(0, len(i), 1 << 16):
                p = slice(at, at + (1 << 16))
                score[p] += np.einsum("ij,ij->i", a.y[i[p], r], b.y[j[p], r])
            fit = score + a.rest[cut][i] * b.rest[cut][j] >= least
            pairs, score = (i[fit], j[fit]), score[fit]
    i, j = pairs
    if 8 * len(i) > len(a.y) * len(b.y):
        exact = (a.unit @ b.unit.T)[i, j]
    else:
        exact = np.concatenate([np.einsum("ij,ij->i", a.unit[i[at : at + (1 << 16)]], b.unit[j[at : at + (1 << 16)]]) for at in range(0, len(i), 1 << 16)] or [np.zeros(0)])
    fit = exact >= threshold
    return i[fit], j[fit]


def _tiles(nodes: DataFrame, dim: int, axes: Axes) -> DataFrame:
    """Tiles of the nodes (x, m, low, k1, k2) of one dimension, in the order of their places."""
    kind = {"float": "f4"}.get(v_type(nodes, "x"), "f8")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            if b.num_rows:
                place = axes.place(_units(_matrix(b.column(0), dim)) @ axes.v)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], names=[*b.schema.names, "place"])

    def tile(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        x = _matrix(t["x"].chunk(0), dim).astype(kind)
        m, low, k1, k2 = (t[c].to_numpy().astype(np.int64) for c in ("m", "low", "k1", "k2"))
        y = _units(x) @ axes.v
        box = np.stack([y.min(axis=0), y.max(axis=0)]).astype(np.float32) + np.array([[-1e-6], [1e-6]], np.float32)
        cells = [number, dim, len(x), x.tobytes(), kind, m.tobytes(), low.tobytes(), np.stack([k1, k2]).tobytes(), box.tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["tile", "dim", "n", "x", "kind", "m", "low", "k", "box"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, TILE - n)
                held.append(part)
                n, b = n + part.num_rows, b.slice(part.num_rows)
                if n == TILE:
                    yield tile(number, held)
                    number, held, n = number + 1, [], 0
        if held:
            yield tile(number, held)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    # the work file has no order of rows, so a tile's number tells where it stands
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = nodes.mapInArrow(placed, f"{kinds}, place long").repartitionByRange(parts, "place", "k1", "k2").sortWithinPartitions("place", "k1", "k2")
    return src.select("x", "m", "low", "k1", "k2").mapInArrow(cut, _TILE)


def _blocks(tiles: DataFrame, dim: int) -> list[tuple[int, int]]:
    """Ranges of tile numbers that hold at most ``BLOCK_VALUES`` values each, in order."""
    most = max(1, BLOCK_VALUES // (TILE * dim))
    out: list[list[int]] = []
    room = 0
    # a row a partition of the sort
    for r in tiles.groupBy(F.shiftright("tile", 32).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        at, n = r["part"] << 32, r["n"]
        while n:
            if not room:
                out.append([at, at])
                room = most
            take = min(room, n)
            at, n, room = at + take, n - take, room - take
            out[-1][1] = at
    return [tuple(x) for x in out]


def _compared(tiles: DataFrame, block: tuple[int, int], axes: Axes, threshold: float) -> DataFrame:
    """(low, dim, k1, k2, links, root): what a task's tiles and the tiles of a block make of each linked node."""
    lo, hi = block
    rows = tiles.filter((F.col("tile") >= lo) & (F.col("tile") < hi)).toArrow().to_pylist()  # BLOCK_VALUES at most
    rows.sort(key=lambda r: r["tile"])
    shared = tiles.sparkSession.sparkContext.broadcast((rows, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, axes = shared.value
        own = [Tile(r, axes) for r in rows]
        first = np.cumsum([0] + [len(t.m) for t in own])
        n = int(first[-1])
        at = {t.number: k for k, t in enumerate(own)}
        links = np.zeros(n, np.int64)
        parent = np.arange(n)
        low = np.concatenate([t.low for t in own]) if own else np.zeros(0, np.int64)
        keys = np.concatenate([np.frombuffer(r["k"], np.int64).reshape(2, -1) for r in rows], axis=1) if rows else np.zeros((2, 0), np.int64)

        def out(low, keys, links, root) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (low, keys[0], keys[1], links, root)], names=["low", "k1", "k2", "links", "root"])

        for b in slices(batches, 1):
            if not b.num_rows:
                continue
            row = b.to_pylist()[0]
            inside = at.get(row["tile"])
            t = own[inside] if inside is not None else Tile(row, axes)
            size = len(t.m)
            mine = np.zeros(size, np.int64)
            # inside the block a tile's nodes are the block's own; others stand behind them
            base = int(first[inside]) if inside is not None else n
            tree = parent if inside is not None else np.concatenate([parent, np.arange(n, n + size)])
            for k, other in enumerate(own[: inside + 1] if inside is not None else own):
                i, j = linked(t, other, axes, threshold)
                if len(i):
                    mine += np.bincount(i, other.m[j], size).astype(np.int64)
                    links[first[k] : first[k + 1]] += np.bincount(j, t.m[i], len(other.m)).astype(np.int64)
                    unite(tree, i + base, j + int(first[k]))
            if inside is not None:
                links[first[inside] : first[inside + 1]] += mine
                continue
            parent = tree[:n]
            hit = np.flatnonzero(mine)
            if len(hit):
                yield out(t.low[hit], np.frombuffer(row["k"], np.int64).reshape(2, -1)[:, hit], mine[hit], low[find(tree, hit + n)])
        hit = np.flatnonzero((links > 0) | (parent != np.arange(n)))
        yield out(low[hit], keys[:, hit], links[hit], low[find(parent, hit)])

    return tiles.filter(F.col("tile") >= lo).mapInArrow(run, "low long, k1 long, k2 long, links long, root long")


def classes(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Of every row: its id, n_links (other rows whose cosine reaches the threshold), component_id (smallest id reachable by links) and kept.

    Every pair is covered; the order of the axes and tiles decides only how soon
    a pair ends. A vector that is null, empty or zero, or holds a null or a
    non-finite component, and a row without an id link with nothing: no links,
    their own id as component, kept. Equal rows are linked like others. Vectors
    of different lengths are not linked. Rows of one id are one in components, and kept
    if that id is the smallest. Other columns are ignored; an empty table gives
    an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = rows.sparkSession
    importable(spark)
    src = keyed(rows, id_col, vec_col)
    nodes = src.filter("x IS NOT NULL").groupBy("k1", "k2").agg(F.first("x").alias("x"), F.count("*").alias("m"), F.min("id").alias("low"))
    nodes = saved(nodes.select("x", "m", "low", "k1", "k2"), "dedup-nodes")
    sizes = nodes.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.sum("m").alias("rows")).collect()
    found = None
    for r in sorted(sizes, key=lambda r: r["dim"]):
        dim, n = r["dim"], r["n"]
        own = nodes.filter(F.size("x") == dim)
        part = F.pmod(F.xxhash64(F.lit(3), "k1"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE_VALUES / dim / n) * (1 << 30)))
        sample = own.filter(part).select("x").limit(2 * max(1, SAMPLE_VALUES // dim)).toArrow()["x"].combine_chunks()
        axes = Axes(_units(_matrix(sample, dim)) if len(sample) else np.eye(dim))
        tiles = saved(_tiles(own, dim, axes), "dedup-tiles")
        for block in _blocks(tiles, dim):
            out = saved(_compared(tiles, block, axes, threshold), "dedup-links")
            found = out if found is None else found.unionByName(out)
    if found is None:
        return src.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    label = components(found.filter("low != root").select(F.col("low").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    known = nodes.select("k1", "k2", "m", "low").join(links, ["k1", "k2"], "left").join(label.withColumnRenamed("id", "low"), "low", "left")
    known = known.select("k1", "k2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "low").alias("component_id"), "m", "low")
    known = saved(known.filter("m > 1 OR n_links > 0 OR component_id != low").drop("low"), "dedup-known")
    # a row has its node's figures: those of very large groups come by broadcast, so that no key is hot
    total = sum(r["rows"] for r in sizes)
    heavy = known.filter(F.col("m") * HEAVY > total).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.struct("n_links", "component_id").alias("h"))
    light = known.filter(F.col("m") * HEAVY <= total).select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.struct("n_links", "component_id").alias("l"))
    out = src.select("id", "k1", "k2").join(F.broadcast(heavy), (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    key = F.when(F.col("k1").isNotNull() & F.col("h").isNull(), F.col("k1")).otherwise(F.xxhash64(F.lit(4), "id"))
    out = out.withColumn("j1", key).join(light, (F.col("j1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left").select("id", F.coalesce("h", "l").alias("got"))
    comp = F.coalesce("got.component_id", "id")
    drop(tiles)
    return out.select(F.col("id").alias(id_col), F.coalesce("got.n_links", F.lit(0).cast("long")).alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def oracle_sql() -> str:
    return """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_inner_product(x.v, y.v) >= 0.9 * sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
