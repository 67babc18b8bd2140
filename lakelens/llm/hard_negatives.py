"""Hard negatives by coordinate pruning over length buckets.

Vectors are sorted by length and cut into buckets of like length; a bucket
holds, for each coordinate, its vectors sorted by that coordinate of their
direction. For an anchor and a score to reach, a bucket's greatest length gives
the cosine that a vector of it needs, and that cosine leaves an interval for
each coordinate of its direction. The intervals of the anchor's focus
coordinates (its largest ones) are looked up in the sorted lists and
intersected; what remains is scored exactly. The score to reach rises with the
best ones found. Positives come first, as their scores bound the negatives'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, importable, saved, slices

#: Vectors a bucket, anchors a block (what is broadcast at once), focus coordinates.
BUCKET, BLOCK, FOCUS = 4096, 2048, 3
#: One bucket in so many gives a first bound of each score.
STRIDE = 16
#: Integer products up to here are exact in doubles.
EXACT = 2**53
#: Room for rounding in cosines and coordinates.
SLACK = 1e-9
_INDEX = "bucket long, dim int, low double, high double, ids binary, labels binary, v binary, kind string, lists binary"


def usable(rows: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, label, x, len): rows that take part, with their vectors as doubles and the length of floor(scale * x)."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0)))
    return rows.filter(ok).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("x"), F.sqrt(square).alias("len"))


def _vectors(column: pa.Array, scale: int) -> list[np.ndarray]:
    """floor(scale * x) of each vector of a column without nulls."""
    flat = np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(sizes)[:-1])


def index(rows: DataFrame, scale: int) -> DataFrame:
    """Length buckets of rows as ``usable`` makes them: lengths, ids, labels, vectors and sorted coordinate lists.

    Rows are sorted by dimension and length, and spread by a hash of the id
    where many have one length; repeated rows (one id, label and vector) count once.
    """

    def bucket(number: int, part: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        ids, labels = (np.array([p[k] for p in part], np.int64) for k in (0, 1))
        v = np.vstack([p[2] for p in part])
        length = np.sqrt((v.astype(float) ** 2).sum(1))
        order = np.argsort(_direction(v, length), axis=0, kind="stable").astype(np.uint16).T
        narrow = np.abs(v).max(initial=0) < 2**31
        cells = [number, v.shape[1], length.min(), length.max(), ids.tobytes(), labels.tobytes(), (v.astype(np.int32) if narrow else v).tobytes(), "i4" if narrow else "i8", np.ascontiguousarray(order).tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["bucket", "dim", "low", "high", "ids", "labels", "v", "kind", "lists"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        number = 0
        for b in batches:
            for i, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _vectors(b.column(2), scale) if b.num_rows else []):
                if held and (len(held) == BUCKET or len(held[-1][2]) != len(v)):
                    yield bucket(number, held)
                    held, number = [], number + 1
                if not held or held[-1][0] != i or held[-1][1] != label or (held[-1][2] != v).any():
                    held.append((i, label, v))
        if held:
            yield bucket(number, held)

    spread = F.xxhash64("id")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = rows.repartitionByRange(parts, F.size("x"), "len", spread, "id").sortWithinPartitions(F.size("x"), "len", spread, "id", "label", "x")
    return saved(src.select("id", "label", "x").mapInArrow(run, _INDEX), "negatives-index")


def _direction(v: np.ndarray, length: np.ndarray) -> np.ndarray:
    return v / np.where(length > 0, length, 1)[:, None]


class Bucket:
    """A bucket as read: its vectors, and for each coordinate the sorted values of their directions."""

    def __init__(self, b: pa.RecordBatch):
        _, self.dim, self.low, self.high, ids, labels, v, kind, lists = (b.column(c)[0].as_py() for c in range(9))
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.v = np.frombuffer(v, kind).reshape(-1, self.dim)
        self.lists = np.frombuffer(lists, np.uint16).reshape(self.dim, -1)
        length = np.sqrt((self.v.astype(float) ** 2).sum(1))
        self.unit = _direction(self.v, length)
        self.values = np.take_along_axis(self.unit.T, self.lists.astype(np.intp), axis=1)

    def feasible(self, a: Anchors, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor: whether the bucket can hold a score of ``least``, and the ends of its focus coordinates' intervals in value.

        With the anchor at an angle b from a coordinate's axis, a direction
        within the angle g of it lies at an angle of b - g to b + g from that axis.
        """
        reach = np.where(least > 0, self.high, self.low) * a.length
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(reach > 0, least / reach, np.where(least > 0, np.inf, -1.0)) - SLACK
        g = np.arccos(np.clip(need, -1, 1))[:, None]
        return need <= 1, np.cos(np.minimum(np.pi, a.angle + g)) - SLACK, np.cos(np.maximum(0, a.angle - g)) + SLACK

    def candidates(self, a: Anchors, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, places, scores): all vectors that lie in every focus interval, scored exactly."""
        open_, low, high = self.feasible(a, least)
        first, last = np.zeros(a.focus.shape, np.int64), np.zeros(a.focus.shape, np.int64)
        for f in np.unique(a.focus[open_]):
            at = (a.focus == f) & open_[:, None]
            first[at] = np.searchsorted(self.values[f], low[at], "left")
            last[at] = np.searchsorted(self.values[f], high[at], "right")
        n = last - first
        open_ &= (n > 0).all(axis=1)
        narrowest = n.argmin(axis=1)
        found = {}
        for k in np.flatnonzero(open_):
            s = narrowest[k]
            places = self.lists[a.focus[k, s], first[k, s] : last[k, s]]
            for o in range(a.focus.shape[1]):
                if o != s and n[k, o] < len(self.ids):
                    x = self.unit[places, a.focus[k, o]]
                    places = places[(x >= low[k, o]) & (x <= high[k, o])]
            if len(places):
                found[k] = places
        dense = [k for k, p in found.items() if 8 * len(p) > len(self.ids)]
        exact = float(np.abs(self.v).max(initial=0)) * float(np.abs(a.v).max(initial=0)) * self.dim < EXACT
        kind = np.float64 if exact else np.int64
        v, q = self.v.astype(kind), a.v.astype(kind)
        for at in range(0, len(dense), 256):  # many candidates: one product for several anchors
            part = dense[at : at + 256]
            for k, s in zip(part, q[part] @ v.T):
                yield k, found[k], s[found[k]].astype(np.int64)
        for k in found.keys() - set(dense):
            yield k, found[k], (v[found[k]] @ q[k]).astype(np.int64)


class Anchors:
    """A block of anchors of one dimension: vectors, lengths, focus coordinates and the angles to their axes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        self.length = np.sqrt((v.astype(float) ** 2).sum(1))
        unit = _direction(v, self.length)
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        self.angle = np.arccos(np.clip(np.take_along_axis(unit, self.focus, axis=1), -1, 1))


def _search(buckets: DataFrame, anchors: Anchors, windows: list[list[tuple[float, float, int]]], k: int, same: bool) -> DataFrame:
    """(anchor, window, id, score): for each window (least score, greatest score, tag) of each anchor, a task's ``k`` best rows of the same or of another label."""
    shared = buckets.sparkSession.sparkContext.broadcast((anchors, windows))  # a block at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, windows = shared.value
        best = {(i, w): np.zeros((0, 2), np.int64) for i, own in enumerate(windows) for w in range(len(own))}
        edge = [[x[0] for x in own] for own in windows]
        least = np.array([min(e, default=np.inf) for e in edge])
        for b in slices(batches, 1):
            if not b.num_rows or b.column(1)[0].as_py() != a.v.shape[1]:
                continue
            bucket = Bucket(b)
            for i, places, scores in bucket.candidates(a, least):
                fit = (scores >= least[i]) & ((bucket.labels[places] == a.labels[i]) == same) & (bucket.ids[places] != a.ids[i])
                if not fit.any():
                    continue
                rows = np.column_stack([scores[fit], bucket.ids[places[fit]]])
                for w, (_, most, _) in enumerate(windows[i]):
                    new = rows[(rows[:, 0] >= edge[i][w]) & (rows[:, 0] <= most)]
                    if len(new):
                        new = np.vstack([best[i, w], new])
                        best[i, w] = new = new[np.lexsort((new[:, 1], -new[:, 0]))[:k]]
                        if len(new) == k:
                            edge[i][w] = int(new[-1, 0])
                least[i] = min(edge[i])
        held = [(i, w) for (i, w), x in best.items() if len(x)]
        n = [len(best[x]) for x in held]
        rows = np.vstack([best[x] for x in held]) if held else np.zeros((0, 2), np.int64)
        cells = [np.repeat(np.array([f(i, w) for i, w in held], np.int64), n) for f in (lambda i, w: a.ids[i], lambda i, w: w)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*cells, rows[:, 1], rows[:, 0])], names=["anchor", "w", "id", "score"])

    found = buckets.mapInArrow(run, "anchor long, w long, id long, score long")
    w = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _raised(buckets: DataFrame, n_buckets: int, anchors: Anchors, windows: list, k: int, same: bool) -> list:
    """The windows, begun at the score of the k-th best row among one bucket in ``STRIDE``: no row of the result lies below."""
    if n_buckets < 4 * STRIDE:
        return windows  # a bound would cost as much as it saves
    part = buckets.filter(F.pmod(F.xxhash64("bucket", "low", F.length("ids")), F.lit(STRIDE)) == 0)
    place = {i: n for n, i in enumerate(anchors.ids.tolist())}
    out = [list(own) for own in windows]
    for r in _search(part, anchors, windows, k, same).filter(F.col("rank") == k).collect():  # a row a window of the block
        low, most, tag = out[place[r["anchor"]]][r["w"]]
        out[place[r["anchor"]]][r["w"]] = (max(low, r["score"]), most, tag)
    return out


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low_pct: int = 30, high_pct: int = 90, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are integer inner products of floor(scale * x), x as double, which
    must fit 64 bits; higher ones come first, ties by smaller id. An anchor's
    positives are its first ``positives`` other rows of the same label, a
    positive's negatives the first ``negatives`` rows of another label whose
    score is from ``low_pct`` to ``high_pct`` percent of the positive's.

    Rows without an id or a label, and rows whose vector is null, empty or holds
    a null or a non-finite component take no part. Only vectors of one dimension
    are compared. A row that repeats (id, label and vector) counts once; rows of
    one id that differ each count, never for each other; of anchors of one id
    the smallest by label and vector is taken. Other columns are ignored; empty
    tables, anchors without positives and positives without negatives give no rows.
    """
    spark = rows.sparkSession
    importable(spark)
    buckets = index(usable(rows, id_col, label_col, vec_col, scale), scale)
    sizes = {r["dim"]: r["n"] for r in buckets.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    heads = usable(anchors, id_col, label_col, vec_col, scale).groupBy("id").agg(F.min(F.struct("label", "x")).alias("a")).select("id", "a.label", "a.x")
    heads = saved(heads, "negatives-anchors")
    counts = {r["dim"]: r["n"] for r in heads.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).collect()}
    parts = []
    for dim, n in sorted(counts.items()):
        n_blocks = -(-n // BLOCK)
        for i in range(n_blocks if dim in sizes else 0):
            t = heads.filter((F.size("x") == dim) & (F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == i)).toArrow().combine_chunks()
            if not t.num_rows:
                continue
            block = Anchors(t["id"].to_numpy(), t["label"].to_numpy(), np.vstack(_vectors(t["x"].chunk(0), scale)))
            own = buckets.filter(F.col("dim") == dim)
            windows: list[list] = [[(-np.inf, np.inf, 0)] for _ in block.ids]
            windows = _raised(own, sizes[dim], block, windows, positives, True)
            found = _search(own, block, windows, positives, True).select("anchor", "rank", "id", "score").collect()  # a few rows an anchor of the block
            by = {}
            for r in sorted(found, key=lambda r: (r["anchor"], r["rank"])):
                by.setdefault(r["anchor"], []).append((-(-low_pct * r["score"] // 100), high_pct * r["score"] // 100, (r["id"], r["score"])))
            windows = [[w for w in by.get(a, []) if w[0] <= w[1]] for a in block.ids.tolist()]
            tags = [(a, k, *w[2]) for a, own_ in zip(block.ids.tolist(), windows) for k, w in enumerate(own_)]
            if not tags:
                continue
            windows = _raised(own, sizes[dim], block, windows, negatives, False)
            named = spark.createDataFrame(tags, "anchor long, w long, positive_id long, positive_score long")  # of this block
            out = _search(own, block, windows, negatives, False).join(F.broadcast(named), ["anchor", "w"])
            out = out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            parts.append(saved(out, "negatives") if n_blocks > 1 else out)
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    drop(heads)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def oracle_sql() -> str:
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
