"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one feature at a time, so their sum is one
lookup table a feature; then the pairs that cut the remaining error most get
two-dimensional tables the same way. A document's score is the logistic of a
sum of table entries, found by vectorised binning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, share, slices

#: Bound of the training sample (rows, chosen by a hash of the id).
MAX_ROWS = 20_000
BINS, PAIR_BINS, N_PAIRS, ROUNDS, PAIR_ROUNDS, RATE, MIN_LEAF = 32, 8, 5, 120, 60, 0.1, 20.0
FEATURES = ("log_words", "mean_word", "symbol_words", "upper", "digits", "stops", "commas", "shouts", "bars", "same_next", "distinct", "dup_lines", "line_words", "non_ascii")
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def features(text: str) -> list[float]:
    """The figures of ``FEATURES`` for a whole text; all zero for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = max(1, len(text) - sum(map(text.count, SPACE)))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    distinct = len(set(words))
    plain = text.encode("ascii", "ignore")
    return [
        math.log1p(n),
        chars / n,
        sum(map(text.count, SYMBOLS)) / n,
        np.count_nonzero(capitals()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]) / chars,
        sum(map(text.count, "0123456789")) / chars,
        (text.count(". ") + text.count(".\n")) / n,
        text.count(",") / n,
        (text.count("!!") + text.count("??")) / n,
        text.count("|") / n,
        (n - 1 - sum(map(str.__ne__, words, words[1:]))) / n,
        distinct / n**0.8,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        (len(text) - len(plain)) / chars,
    ]


@lru_cache(1)
def capitals() -> np.ndarray:
    """Whether each code point is a capital letter."""
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)


@dataclass
class Model:
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (cut, tab) in enumerate(zip(self.cuts, self.tables)):
            out += tab[np.searchsorted(cut, x[:, j])]
        for (a, b), tab in zip(self.pairs, self.pair_tables):
            out += tab[np.searchsorted(self.pair_cuts[a], x[:, a]), np.searchsorted(self.pair_cuts[b], x[:, b])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Logistic of the margin; 0 for a text without a word, of which no table knows anything."""
        return np.where(x[:, 0] > 0, 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30))), 0.0)


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of at most four leaves over ordered bins with gradient and weight sums."""

    def best(lo: int, hi: int) -> int | None:
        cg, ch = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        tg, th = g[lo:hi].sum(), h[lo:hi].sum()
        gain = np.where((ch > MIN_LEAF / 8) & (th - ch > MIN_LEAF / 8), cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1), 0) if len(cg) else np.zeros(1)
        k = int(gain.argmax())
        return lo + k + 1 if gain[k] > 1e-9 else None

    edges = [0, len(g)]
    if (m := best(0, len(g))) is not None:
        edges = sorted({0, m, len(g), *(x for x in (best(0, m), best(m, len(g))) if x)})
    out = np.zeros(len(g))
    for lo, hi in zip(edges, edges[1:]):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both axes: its gain and the four leaf values as a table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, where = 0.0, None
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            parts = [(cg[i, j], ch[i, j]), (cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j]), (cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j])]
            parts.append((cg[-1, -1] - sum(p[0] for p in parts), ch[-1, -1] - sum(p[1] for p in parts)))
            gain = sum(a * a / (b + 1) for a, b in parts) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
            if gain > best:
                best, where = gain, (i + 1, j + 1, [a / (b + 1) for a, b in parts])
    out = np.zeros(g.shape)
    if where:
        i, j, (p, q, r, s) = where
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = p, q, r, s
    return best, out


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of main effects, then of the strongest pairs."""
    p = (y.sum() + 1) / (len(y) + 2)
    m = Model([_cuts(c, BINS) for c in x.T] if len(x) else [np.zeros(0)] * len(FEATURES), [], base=math.log(p / (1 - p)))
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    if len(np.unique(y)) < 2:
        return m
    margin = np.full(len(y), m.base)
    at = [np.searchsorted(c, x[:, j]) for j, c in enumerate(m.cuts)]

    def residual() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-margin))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for j, tab in enumerate(m.tables):
            g, h = residual()
            add = RATE * np.clip(_step(np.bincount(at[j], g, len(tab)), np.bincount(at[j], h, len(tab))), -4, 4)
            tab += add
            margin += add[at[j]]
    m.pair_cuts = [_cuts(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(c, x[:, j]) for j, c in enumerate(m.pair_cuts)]
    size = [len(c) + 1 for c in m.pair_cuts]

    def sums(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * size[b] + coarse[b], v, size[a] * size[b]).reshape(size[a], size[b])

    g, h = residual()
    gains = sorted(((-_quadrants(sums(a, b, g), sums(a, b, h))[0], a, b) for a in range(len(size)) for b in range(a + 1, len(size))))
    m.pairs = [(a, b) for gain, a, b in gains[:N_PAIRS] if gain < -1e-6]
    m.pair_tables = [np.zeros((size[a], size[b])) for a, b in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), tab in zip(m.pairs, m.pair_tables):
            g, h = residual()
            add = RATE * np.clip(_quadrants(sums(a, b, g), sums(a, b, h))[1], -4, 4)
            tab += add
            margin += add[coarse[a], coarse[b]]
    return m


def _feature_rows(src: DataFrame, model=None) -> DataFrame:
    """id and either the feature array or, with a broadcast model, the score."""
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [features(t or "") for t in b.column(1).to_pylist()]
            out = pa.array(x, pa.list_(pa.float64())) if model is None else pa.array(model.value.score(np.array(x)), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["id", "out"])

    return src.mapInArrow(run, f"id {kind}, out {'array<double>' if model is None else 'double'}")


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> pd.DataFrame:
    """Features and label of at most about ``max_rows`` labelled rows; only these reach the driver."""
    rows = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("y")).filter("lid IS NOT NULL AND y IS NOT NULL")
    n = rows.count()
    rows = rows.filter(share("lid") < F.lit(max_rows / max(1, n))).limit(2 * max_rows)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # the labelled side is bounded by max_rows above, so it may be sent to every task
    src = src.join(F.broadcast(rows), src["id"] == rows["lid"]).select(F.struct("id", "y").alias("id"), "text")
    got = _feature_rows(src).select("id.id", "id.y", "out").toArrow().to_pandas()
    return got.sort_values(["id", "y"], kind="stable").reset_index(drop=True)


def score(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """Score every whole text of ``docs``: the id column and ``score`` (0 to 1, higher: label 1 likelier).

    The model learns from the rows of ``train_docs`` that ``labels`` marks (ids
    null or without a label take no part; no labels at all: every score is 0.5).
    Null texts and texts without a word score 0; texts of any length are read
    whole. Extra columns, whatever their names, are ignored; repeated rows and
    rows without an id score alike; an empty table gives an empty result.
    """
    importable(docs.sparkSession)
    rows = training_rows(train_docs, labels, max_rows, id_col, text_col, label_col)
    model = learn(np.array(rows["out"].tolist()).reshape(len(rows), len(FEATURES)), rows["y"].to_numpy(float))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed tables
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _feature_rows(src, shared).select(F.col("id").alias(id_col), F.col("out").alias("score"))
