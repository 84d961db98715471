"""Takes over streams of clips: the gap and counter rules with keyed state, event order and timers.

A clip waits in its key's state until the watermark has passed its start, so clips that arrive out of order within the
allowed lateness are taken in order; later ones are dropped.  A key's state is what waits, and the end of the open take;
it goes once the watermark is a gap beyond that end, since whatever comes then starts a take of its own.  State and
timers are Spark's, so a restart from the checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The state store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Clips that came together lie in one row, a list for each column: state is read and written row by row.
_WAITING = "start_ms array<long>, clip_id array<string>, end_ms array<long>, first_frame array<long>, last_frame array<long>"
_OPEN = "end_ms long, frame long, take_ms long, position long"


def _columns(rows: list[tuple]) -> tuple[list, ...]:
    return tuple(map(list, zip(*rows, strict=True)))


class _Takes(StatefulProcessor):
    def __init__(self, keys: list[str], gap_ms: int, frames: str | None) -> None:
        self.keys, self.gap_ms, self.frames = keys, gap_ms, frames

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, new = timerValues.getCurrentWatermarkInMs(), []
        for batch in rows:
            some = batch[["start_ms", "clip_id", "end_ms", "first_frame", "last_frame"]]
            new += [(int(a), c, int(b), int(f), int(g)) for a, c, b, f, g in some.itertuples(index=False) if a >= now]
        if new:
            self.waiting.appendValue(_columns(new))
            # One timer, of the first clip, takes out all that is due and sets the next: a timer each is a call of Python each.
            self.handle.registerTimer(min(new)[0])
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(clip for some in self.waiting.get() for clip in zip(*some, strict=True)) if self.waiting.exists() else []
        due = [x for x in rows if x[0] <= now]
        last = self.open.get()
        out = []
        for start, clip, end, first, final in due:
            new = last is None or start - last[0] > self.gap_ms or (self.frames is not None and first < last[1])
            last = (end, final if self.frames == "last_frame" else first, start if new else last[2], 0 if new else last[3] + 1)
            out.append((*key, clip, last[2], last[3]))
        if due:
            rest = rows[len(due) :]
            if rest:
                self.waiting.put([_columns(rest)])
                self.handle.registerTimer(rest[0][0])
            else:
                self.waiting.clear()
            self.open.update(last)
            self.handle.registerTimer(max(last[0] + self.gap_ms, now) + 1)
        elif last is not None and not rows and now > last[0] + self.gap_ms:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "clip_id", "take_ms", "position"])

    def close(self) -> None:
        pass


def stream_takes(clips: DataFrame, gap_ms: int, late: str, keys: list[str], frames: str | None = "last_frame", time: str = "ts") -> DataFrame:
    """``keys, clip_id, take_ms, position`` of a stream of clips: the start (ms) of each clip's take, and its place there.

    A take ends where the next clip of its key starts over ``gap_ms`` after it, or with a ``first_frame`` below the
    column ``frames`` of the clip before (None: no such rule); clips of one start go by ``clip_id``, as in
    ``spans.gap_takes``.  ``clips``: ``keys``, ``clip_id``, ``time`` (start), ``end_ms``, ``first_frame``, ``last_frame``.
    """
    spark = clips.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    started = clips.withWatermark(time, late).select(*keys, time, F.unix_millis(time).alias("start_ms"), "clip_id", F.col("end_ms").cast("long"), *(F.col(c).cast("long") for c in ("first_frame", "last_frame")))
    kinds = {f.name: f for f in clips.schema}
    out = StructType([kinds[k] for k in keys]).add("clip_id", "string").add("take_ms", "long").add("position", "long")
    return started.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Takes(keys, gap_ms, frames), outputStructType=out, outputMode="append", timeMode="eventtime")
