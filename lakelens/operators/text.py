"""Text operators: decoding, markup removal, chunks, sampling plans and vector checks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import present, ranked

#: Encodings in the order in which bytes are tried.
ENCODINGS = ("utf-8-sig", "gb18030", "big5", "latin-1")


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """HTML character references decoded, batch by batch."""
    return texts.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def clean_markup(markup: Column) -> Column:
    """Text of a markup string: scripts and styles dropped, tags to blanks, references decoded, blanks collapsed."""
    c = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    c = unescaped(F.regexp_replace(c, r"(?s)<[^>]*>", " "))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def plain_markup(markup: Column, references: dict[str, str]) -> Column:
    """As ``clean_markup`` by built-in functions alone: only the listed references are decoded, each as written and in that order, and blanks are those of ASCII."""
    c = F.regexp_replace(markup, r"(?is)<script.*?</script[\t\n\f\r ]*>|<style.*?</style[\t\n\f\r ]*>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, char in references.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, r"[\t\n\f\r ]+", " "))


def decoded(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def decode_files(files: DataFrame, bytes_col: str = "content", id_col: str = "id") -> DataFrame:
    """(id, text): bytes decoded by the first encoding that fits; the last one always does."""
    kind = files.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({id_col: p[id_col], "text": [None if b is None else decoded(bytes(b)) for b in p[bytes_col]]})

    return files.select(id_col, bytes_col).mapInPandas(run, f"{id_col} {kind}, text string")


#: What ends a sentence or a line; of a full stop with a blank the blank stays outside.
_MARK = re.compile(r"[\n。！？]|\. ")


class Marks:
    """The places of all marks of a text, found in one pass: where each begins, is complete, and lets a chunk end."""

    def __init__(self, text: str):
        at = np.array([m.span() for m in _MARK.finditer(text)], np.int64).reshape(-1, 2)
        self.begin, self.complete = at[:, 0], at[:, 1]

    def last(self, low: int, high: int) -> int | None:
        """End of a chunk at the last mark that lies between two places."""
        k = int(np.searchsorted(self.complete, high, "right")) - 1
        return int(self.begin[k]) + 1 if k >= 0 and self.begin[k] >= low else None


def spans(text: str, size: int = 1200, overlap: int = 120) -> list[tuple[int, int]]:
    """Start and end of each chunk of a trimmed text.

    A chunk of at most ``size`` characters ends behind the last mark in the second
    half of its window, else with the window; the last one ends with the text.
    The next chunk begins ``overlap`` characters before, but always further on.
    """
    marks, out, start = Marks(text), [], 0
    while text and (not out or out[-1][1] < len(text)):
        window = start + size
        end = len(text) if window >= len(text) else marks.last(start + size // 2, window) or window
        out.append((start, end))
        start = max(start + 1, end - overlap)
    return out


def chunks(docs: DataFrame, id_col: str = "id", text_col: str = "text", size: int = 1200, overlap: int = 120) -> DataFrame:
    """One row a chunk: id, chunk_index, content, start_offset, end_offset in the trimmed text. Blank and null texts give none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for at in range(0, b.num_rows, 64):  # whole texts are long
                rows = []
                for k, text in enumerate(b.column(1)[at : at + 64].to_pylist()):
                    text = (text or "").strip()
                    rows += [(at + k, i, text[x:y], x, y) for i, (x, y) in enumerate(spans(text, size, overlap))]
                of, *rest = zip(*rows) if rows else ((), (), (), (), ())
                ids = b.column(0).take(pa.array(of, pa.int64()))
                kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(rest, kinds))], names=[id_col, "chunk_index", "content", "start_offset", "end_offset"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, chunk_index int, content string, start_offset int, end_offset int")


def assemble(sections: DataFrame, segments: DataFrame, frames: DataFrame, captions: DataFrame) -> DataFrame:
    """All chunks of a file in one order: sections, transcript segments, frame captions; the caption if there is nothing else.

    Inputs have file_id, ord, content, label; segments and frames also start_time.
    """
    blank = F.lit(None).cast("double")
    cols = lambda d, k: d.select("file_id", F.lit(k).alias("part"), "ord", "content", "label", (F.col("start_time") if "start_time" in d.columns else blank).alias("start_time"))
    rows = cols(sections, 0).unionByName(cols(segments, 1)).unionByName(cols(frames, 2)).filter(F.trim("content") != "")
    alone = cols(captions, 3).join(rows.select("file_id").distinct(), "file_id", "left_anti")
    rows = rows.unionByName(alone)
    return rows.withColumn("chunk_index", ranked("file_id", "part", "ord") - 1).select("file_id", "chunk_index", "content", "label", "start_time")


def section_label(part: Column) -> Column:
    """``page n``, ``sheet n`` or ``slide n`` of a part's name."""
    n = F.regexp_extract(part, r"(page|sheet|slide)[^0-9]*([0-9]+)", 2)
    return F.when(n != "", F.concat(F.regexp_extract(part, r"(page|sheet|slide)", 1), F.lit(" "), n.cast("int").cast("string")))


def evidence(chunk_rows: DataFrame, files: DataFrame, per_file: int = 8, chars: int = 6000) -> DataFrame:
    """First chunks of every file joined by line ends, else its caption or text, cut to a length."""
    top = chunk_rows.withColumn("k", ranked("file_id", "chunk_index")).filter(F.col("k") <= per_file)
    joined = top.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda s: s["content"]), "\n").alias("joined"))
    f = files.join(joined, files["id"] == joined["file_id"], "left")
    return f.select("id", F.substring(F.coalesce(present(F.col("joined")), present(F.col("manual_caption")), present(F.col("caption")), F.col("text")), 1, chars).alias("evidence"))


def review_rows(comments: DataFrame, assets: DataFrame) -> DataFrame:
    """Flat review rows in the order of asset, time and id."""
    a = assets.select(F.col("id").alias("asset_id"), "title", "project_id")
    return comments.join(a, "asset_id").select("project_id", "title", F.col("id").alias("comment_id"), "t", "body", "visibility", "resolved")


def markers(comments: DataFrame, private: str = "[internal] ") -> DataFrame:
    """Timeline markers: start, duration, and text with its line ends and quotes escaped."""
    start = F.greatest(F.lit(0.0), "t")
    body = F.regexp_replace(F.regexp_replace("body", r"[\r\n\t]+", " "), '"', "'")
    return comments.select("id", start.alias("start"), F.greatest(F.lit(0.04), F.coalesce(F.col("t_end"), start + 1) - start).alias("duration"), F.concat(F.when(F.col("visibility") == "internal", private).otherwise(""), body).alias("text"))


def write_csv_with_mark(rows: DataFrame, path: str) -> None:
    """CSV whose header begins with the byte-order mark, for spreadsheet programs."""
    first, *_ = rows.columns
    rows.withColumnRenamed(first, "﻿" + first).write.option("header", True).csv(path)


def sample_times(duration: Column, n: int, gap: float = 0.5) -> Column:
    """Boundary times and ``n`` evenly spread times of a video, each at least ``gap`` after the one kept before."""
    early, late = F.least(F.lit(0.1), duration / 4), duration - F.least(F.lit(0.3), duration / 4)
    spread = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: duration * i / (n + 1))
    every = F.array_sort(F.concat(F.array(early, late), spread))
    keep = lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(x))).otherwise(acc)
    return F.when(duration > 0, F.aggregate(every, F.array().cast("array<double>"), keep)).otherwise(F.array().cast("array<double>"))


def audio_windows(duration: Column, most: int, length: float = 30.0) -> Column:
    """Starts of windows over a recording: end to end, or spread evenly when there are too many."""
    n = F.greatest(F.lit(1), F.ceil(duration / length)).cast("int")
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (duration - length) * i / max(1, most - 1))
    return F.when(n <= most, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(length))).otherwise(even)


def vector_faults(rows: DataFrame, dim: int, col: str = "embedding", tolerance: float = 1e-2) -> Column:
    """Why a vector is rejected (null: it is good): wrong size, a non-finite part, no length, not of unit length."""
    v = F.col(col)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(v.isNull() | (F.size(v) != dim), "size").when(~F.coalesce(finite, F.lit(False)), "not finite").when(norm == 0, "zero").when(F.abs(norm - 1) > tolerance, "not unit")
