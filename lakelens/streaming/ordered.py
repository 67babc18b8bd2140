"""Folds over the rows of a key in order of event time, on streams whose rows come late and out of order."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.session import importable

#: The state store that timers and list states need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: A time that pandas can still say, in seconds (the year 2242).
END_S = 1 << 33
#: Rows of an output frame, seconds of the shortest slice of held rows, most rows of a longer slice, rows that are taken in before they are dealt to slices.
ROWS, SLICE_S, SLICE_ROWS, TAKEN = 10_000, 3600, 8192, 1 << 18


class OrderedFold(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then folds them in order of (t, value).

    ``held`` are the rows not yet folded, at most those of the time that rows may
    be late, in slices of time of some parts each. A slice is as many hours as hold few rows together, so that a key of few
    rows has one, and an hour of many rows is a slice alone. ``slices`` says where each begins and what it holds, and when the key's next
    timer is: at the earliest row or before it. Then all rows that are due are read and folded, one slice after the
    other. ``folded`` is the fold's state and the time of its last row; ``idle_ms`` after that there is a timer at which the state of a quiet key goes.
    """

    def __init__(self, step: Callable, columns: list[str], state: str, value: str, idle_ms: int | None):
        self.step, self.columns, self.state, self.value, self.idle_ms = step, columns, state, value, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slice long, part int", f"t array<long>, v array<{self.value}>")
        self.slices = handle.getValueState("slices", "first array<long>, parts array<int>, n array<long>, timer long")
        self.folded = handle.getValueState("folded", f"t long, s {self.state}")

    def _read(self) -> tuple[list[list[int]], int | None]:
        """The slices in order, each by its first hour, its parts and its rows, and the next timer."""
        if not self.slices.exists():
            return [], None
        *columns, timer = self.slices.get()
        return [[int(x) for x in s] for s in zip(*columns)], timer

    def _part(self, piece: list[int], rows: list[tuple]) -> None:
        """Add rows to a slice."""
        times, values = map(list, zip(*rows))
        self.held.updateValue((piece[0], piece[1]), (times, values))
        piece[1:] = piece[1] + 1, piece[2] + len(rows)

    def _taken(self, piece: list[int]) -> list[tuple]:
        """The rows of a slice, which then holds none."""
        rows = []
        for part in range(piece[1]):
            rows += zip(*self.held.getValue((piece[0], part)))
            self.held.removeKey((piece[0], part))
        piece[1:] = 0, 0
        return rows

    def _hold(self, slices: list[list[int]], rows: list[tuple]) -> None:
        """Deal rows to the slices; one that gets too many is cut."""
        hour = lambda r: r[0] // SLICE_S
        rows = sorted(rows, key=itemgetter(0))
        if not slices or hour(rows[0]) < slices[0][0]:
            slices.insert(0, [hour(rows[0]), 0, 0])
        at = k = 0
        while at < len(rows):
            end = slices[k + 1][0] if k + 1 < len(slices) else None
            stop = len(rows) if end is None else bisect_left(rows, end, at, key=hour)
            if stop > at and slices[k][2] + stop - at > SLICE_ROWS and slices[k][0] + 1 != end:
                rows[at:stop] = sorted(self._taken(slices[k]) + rows[at:stop], key=itemgetter(0))
                stop = len(rows) if end is None else bisect_left(rows, end, at, key=hour)
                slices[k : k + 1] = [[first, 0, 0] for first in _cuts(map(hour, rows[at:stop]), slices[k][0], end)]
                continue
            if stop > at:
                self._part(slices[k], rows[at:stop])
            at, k = stop, k + 1

    def _next(self, first: int, timer: int | None) -> int:
        """The key's timer once a row of the second ``first`` is held."""
        at = (first + 1) * 1000
        if timer is None or at < timer:
            self.handle.registerTimer(at)
            return at
        return timer

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slices, timer = self._read()
        new = []

        def hold():
            self._hold(slices, new)
            return self._next(min(t for t, _ in new), timer)

        for p in rows:
            new += [(int(t), v) for t, v in zip(p["t"].tolist(), p["v"].tolist()) if t < END_S]
            if len(new) >= TAKEN:
                timer, new = hold(), []
        if new:
            timer = hold()
        if slices:
            self.slices.update((*map(list, zip(*slices)), timer))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        slices, timer = self._read()
        open_, due = bool(slices) and timer <= now, 0
        if open_ or self.idle_ms is not None:
            last, state = self.folded.get() if self.folded.exists() else (None, None)
        while open_ and slices and (slices[0][0] * SLICE_S + 1) * 1000 <= now:
            rows = sorted(self._taken(slices[0]))
            n = bisect_right(rows, now, key=lambda r: (r[0] + 1) * 1000)
            due += n
            out = []
            for t, v in rows[:n]:
                state, row = self.step(state, t, v)
                last = t
                if row is not None:
                    out.append((key[0], *row))
            for at in range(0, len(out), ROWS):
                yield pd.DataFrame(out[at : at + ROWS], columns=self.columns)
            if rows[n:]:
                self._part(slices[0], rows[n:])
                timer = self._next(rows[n][0], None)
                break
            slices.pop(0)
        if open_ and not slices:
            self.slices.clear()
        elif open_:
            # of the slices not read only the hour is known
            timer = timer if timer > now else self._next(slices[0][0] * SLICE_S, None)
            self.slices.update((*map(list, zip(*slices)), timer))
        if due:
            self.folded.update((last, state))
            if self.idle_ms is not None:
                self.handle.registerTimer(last * 1000 + self.idle_ms)
        if self.idle_ms is not None and last is not None and last * 1000 + self.idle_ms <= now and not slices:
            self.folded.clear()

    def close(self) -> None:
        pass


def _cuts(hours: Iterable[int], first: int, end: int | None) -> list[int]:
    """First hours of the slices that hold rows of the given hours, in order, from ``first`` up to ``end``: few rows each, or one hour."""
    cuts, n = [first], 0
    for hour, same in groupby(hours):
        m = sum(1 for _ in same)
        if n + m > SLICE_ROWS // 2 and hour > cuts[-1]:
            cuts, n = [*cuts, hour], 0
        n += m
        if n > SLICE_ROWS // 2 and hour + 1 != end:
            cuts, n = [*cuts, hour + 1], 0
    return cuts


def ordered(rows: DataFrame, key: str, value: str, step: Callable, schema: str, late: str, idle_s: int | None, state: str = "long") -> DataFrame:
    """Fold a stream's rows (``key``, t in seconds, ``value``) of each key in order of t, then of the value.

    ``step(state, t, value)`` gives the next state and an output row without the
    key, or None. A row may come up to ``late`` behind the newest one and is
    still folded in its place; later ones are dropped. Results come once the
    watermark has passed. With ``idle_s`` a key's state goes when no row has come for so
    long: the next row then meets no state. Rows without a key or a time are not
    folded. A row's event time is the end of its second, so that the first second of all counts.
    A task reads a key's held rows a slice at a time: an hour (``SLICE_S``), or several of few rows.
    """
    importable(rows.sparkSession)
    out = StructType.fromDDL(schema)
    kind = rows.schema[value].dataType.simpleString()
    src = rows.select(F.col(key), F.col("t").cast("long").alias("t"), F.col(value).alias("v"), F.timestamp_seconds(F.col("t") + 1).alias("_ts")).dropna(subset=[key, "t"]).withWatermark("_ts", late)
    fold = OrderedFold(step, out.fieldNames(), state, kind, None if idle_s is None else idle_s * 1000)
    return src.groupBy(key).transformWithStateInPandas(statefulProcessor=fold, outputStructType=out, outputMode="Append", timeMode="EventTime")


def closed(rows: DataFrame, path: str) -> DataFrame:
    """A stream that ends: one more row at ``END_S`` moves the watermark past all others and is not folded. ``path``: a folder for it."""
    spark = rows.sparkSession
    tick = [F.lit(END_S if f.name == "t" else 0).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    spark.range(1).select(*tick).write.mode("overwrite").parquet(path)
    return rows.union(spark.readStream.schema(rows.schema).parquet(path))
