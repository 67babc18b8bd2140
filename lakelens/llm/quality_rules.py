"""Line-first quality rules: judge lines, drop the bad ones, then judge what is left.

Every line with a word is tested by punctuation, navigation and boilerplate
rules. Lines that fail are removed. A document is rejected when its base
figures are bad (too few words, too much repetition) or when the removed lines
held too much of its text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, slices

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Odd multipliers of the eight places of a window.
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
WINDOW = 8

#: Lower-case phrases of boilerplate lines.
BOILERPLATE = ("all rights reserved", "©", "copyright (c)", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "accept all cookies", "enable javascript", "licensed under ", "released under the ", "sign up for our newsletter", "click here to")
#: Ends of a line's sentences.
_END = re.compile(r"(?<=[.!?|])[ \t]+")


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are of a line's words or of a document's word characters."""

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_share: float = 0.3  # of a line's words that hold a symbol
    min_upper_letters: int = 20  # of a line all in capitals
    min_stutter_words: int = 10
    max_stutter_share: float = 0.5  # of a line's words that equal the next one
    nav_separators: int = 3
    max_phrase_share: float = 0.5  # of a line's characters in sentences with a phrase of boilerplate
    max_lost_share: float = 0.5


def n_repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur at least twice, first occurrences included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    if len(seen) > len(words) - 2:
        return 0  # a repeated window repeats eight words
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        x = ids[k : k + n] * _MULT[k]
        key += x ^ (x >> np.uint64(29))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    if not len(at):
        return 0
    rows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[at]
    _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)  # equal keys are not yet equal windows
    at = at[count[inverse.ravel()] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def base_figures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII white spaces
    chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeated_words(words)


def bad_line(line: str, rules: Rules) -> str | None:
    """The first rule that the line fails: boilerplate, navigation, punctuation or repetition; None if it passes."""
    if any(map(line.lower().__contains__, BOILERPLATE)):
        sentences = _END.split(line)
        if sum(len(x) for x in sentences if any(map(x.lower().__contains__, BOILERPLATE))) > rules.max_phrase_share * sum(map(len, sentences)):
            return "boilerplate"
    if line.count("|") >= rules.nav_separators or line.count(" > ") + line.count(" » ") >= rules.nav_separators:
        return "navigation"
    words = line.split()
    if any(map(line.__contains__, SYMBOLS)) and sum(1 for w in words if any(map(w.__contains__, SYMBOLS))) > rules.max_symbol_share * len(words):
        return "punctuation"
    if line.count("!!") + line.count("???") > rules.max_symbol_share * len(words):
        return "punctuation"
    if line.isupper() and sum(map(str.isalpha, line)) >= rules.min_upper_letters:
        return "punctuation"
    if len(words) >= rules.min_stutter_words and sum(map(eq, words, words[1:])) > rules.max_stutter_share * len(words):
        return "repetition"
    return None


def clean(text: str, rules: Rules = Rules()) -> tuple[str, float, dict[str, int]]:
    """The text without failing lines, the share of word characters lost, and failures by rule."""
    kept, lost, total, failed = [], 0, 0, Counter()
    for line in text.split("\n"):
        size = len(line) - sum(map(line.count, SPACE))
        total += size
        if size and (why := bad_line(line.strip(SPACE), rules)):
            failed[why] += 1
            lost += size
        else:
            kept.append(line)
    return "\n".join(kept), lost / total if total else 0.0, dict(failed)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost_share double, n_bad_lines long, clean_text string, kept boolean"


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Judge every document by its whole text.

    Returns one row per input row: the id and the columns of ``SCHEMA``.
    ``clean_text`` is the text without failing lines (null if ``with_text`` is
    false). A null or empty text has zero words and fails; repeated rows are
    judged alike, and so are rows without an id; extra columns, whatever their
    names, are ignored; one very long line or document is handled whole; an
    empty table gives an empty result.
    """
    importable(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_figures(text)
                failed = base[0] < rules.min_words or 100 * base[4] > rules.max_repeat_pct * base[0]
                left, lost, why = clean(text, rules)
                rows.append((*base, failed, lost, sum(why.values()), left if with_text else None, not failed and lost <= rules.max_lost_share))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.string(), pa.bool_()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, {SCHEMA}").withColumnRenamed("_id", id_col)
