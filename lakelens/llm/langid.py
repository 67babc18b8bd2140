"""Language identification with a string kernel, Nystroem landmarks and ridge regression.

Two texts are compared by how many of their distinct character 1-, 2- and
3-grams they share (blended-spectrum presence kernel, cosine-normalised). A
bounded sample gives landmarks and training rows; the Nystroem map of the
kernel to the landmarks feeds one kernel ridge regression per language. Scoring
a batch is a product of its presence with that of each group of landmarks, over
the n-grams of the group alone, and one of the kernel with the regressions' weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, share, slices

#: Bound of the training sample: rows a language, characters of a row, and landmarks a language.
ROWS_PER_LANG, MAX_CHARS, LANDMARKS_PER_LANG = 250, 20_000, 16
#: Most rows and landmarks of all languages; where there are many languages each has its share, and one at least.
MAX_ROWS, MAX_LANDMARKS = 20_000, 2048
RIDGE, SHARPNESS = 1e-2, 6.0
#: Landmarks whose n-grams are held together: those of a few languages.
GROUP = 64
#: Most languages whose counts are sent to every task.
FEW_LANGS = 10_000
#: Places that n-grams are hashed to.
PLACES = 1 << 19
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_any_letter = regex.compile(r"\p{L}").search


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter; every other character is a border."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _hashed(x: np.ndarray) -> np.ndarray:
    return ((x ^ (x >> np.uint64(31))) * _FACTORS[0] >> np.uint64(64 - 19)).astype(np.int64)


@dataclass
class Model:
    groups: list[tuple[np.ndarray, np.ndarray]]  # codes that some landmark of a group has, and the group's presence (codes x landmarks, a byte each)
    norms: np.ndarray  # distinct n-grams of each landmark
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    langs: list[str]

    def grams(self, text: str) -> np.ndarray:
        """Codes of all 1-, 2- and 3-grams of letters of any script and borders, repeats included."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = np.where(letters()[points], points, 0).astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            one = s * _FACTORS[0]
            two = one[:-1] + s[1:] * _FACTORS[1]
            three = two[:-1] + s[2:] * _FACTORS[2]
            return _hashed(np.concatenate([one, two, three]))

    def distinct(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's distinct codes."""
        seen = np.zeros(PLACES, bool)
        for text in texts:
            g = self.grams(text)
            seen[g] = True
            yield np.flatnonzero(seen)
            seen[g] = False

    def know(self, texts: list[str]) -> None:
        """Take the texts as landmarks."""
        own = list(self.distinct(texts))
        self.norms = np.array([max(1, len(x)) for x in own], float)
        self.groups = []
        for at in range(0, len(own), GROUP):
            part = own[at : at + GROUP]
            codes = np.unique(np.concatenate(part))
            held = np.zeros((len(codes), len(part)), np.uint8)
            for k, x in enumerate(part):
                held[np.searchsorted(codes, x), k] = 1
            self.groups.append((codes, held))

    def kernel(self, texts: list[str]) -> np.ndarray:
        seen = np.zeros(PLACES, bool)
        rows, norms = [np.zeros((len(texts), len(codes)), np.float32) for codes, _ in self.groups], np.ones(len(texts))
        for i, text in enumerate(texts):
            g = self.grams(text)
            seen[g] = True
            for x, (codes, _) in zip(rows, self.groups):
                x[i] = seen[codes]
            norms[i] = max(1, np.count_nonzero(seen))
            seen[g] = False
        common = np.concatenate([x @ held.astype(np.float32) for x, (_, held) in zip(rows, self.groups)], axis=1)
        return common / np.sqrt(norms[:, None] * self.norms[None, :])

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its softmax share."""
        f = (self.kernel(texts) @ self.weights + self.bias) * SHARPNESS
        f = np.exp(f - f.max(axis=1, keepdims=True))
        best = f.argmax(axis=1)
        return best, f[np.arange(len(f)), best] / f.sum(axis=1)


def learn(sample: pd.DataFrame) -> Model | None:
    """Fit on a bounded sample with columns text and lang; None if there is nothing to learn from."""
    sample = sample[[bool(_any_letter(t)) for t in sample["text"]]].reset_index(drop=True)
    if sample.empty:
        return None
    langs = sorted(sample["lang"].unique())
    marks = sample.groupby("lang", sort=True).head(max(1, min(LANDMARKS_PER_LANG, MAX_LANDMARKS // len(langs))))["text"].tolist()
    m = Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0), langs)
    m.know(marks)
    values, vectors = np.linalg.eigh(m.kernel(marks).astype(float))
    top = values > 1e-6 * values.max()
    project = vectors[:, top] / np.sqrt(values[top])
    x = np.vstack([m.kernel(sample["text"].tolist()[i : i + 256]) for i in range(0, len(sample), 256)]) @ project
    y = np.where(sample["lang"].to_numpy()[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    mx, my = x.mean(axis=0), y.mean(axis=0)
    w = np.linalg.solve((x - mx).T @ (x - mx) + RIDGE * len(x) / 100 * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    m.weights, m.bias = (project @ w).astype(np.float32), my - mx @ w
    return m


def training_sample(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> pd.DataFrame:
    """About ``rows_per_lang`` rows of each language, of many languages fewer (about ``MAX_ROWS`` in all), chosen by a hash of the id.

    The first ``MAX_CHARS`` characters of a row; this and the row bound keep what reaches the driver small.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & ((F.length(text_col) > 0)))
    counts = usable.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_n"))  # a row a language
    n = max(1, counts.count())
    rows = max(1, min(rows_per_lang, MAX_ROWS // n))
    picked = usable.select(F.col(id_col).alias("id"), F.substring(text_col, 1, MAX_CHARS).alias("text"), F.col(lang_col).alias("lang"))
    picked = picked.join(F.broadcast(counts) if n <= FEW_LANGS else counts, F.col("lang") == F.col("_lang")).filter(share("id") < F.lit(float(rows)) / F.col("_n")).select("id", "text", "lang")
    return picked.limit(3 * rows * n).toArrow().to_pandas().sort_values(["lang", "id"], kind="stable").reset_index(drop=True)


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """Predict the language of every whole text of ``docs``, learning from ``train``.

    Returns the id column, ``lang_pred`` and ``score`` (0 to 1). A null text, a
    text without a letter, and every text when ``train`` is empty get ``und``
    and 0. Texts of any length are read whole; repeated rows and rows without
    an id are predicted alike; extra columns are ignored; an empty table gives an empty result.
    """
    importable(docs.sparkSession)
    model = learn(training_sample(train, rows_per_lang, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a byte for each n-gram and landmark of a group, whose number and length are bounded
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            at = [i for i, t in enumerate(texts) if m is not None and t and _any_letter(t)]
            if at:
                for i, k, p in zip(at, *m.predict([texts[i] for i in at])):
                    lang[i], score[i] = m.langs[k], float(p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
