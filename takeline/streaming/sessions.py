"""Gap sessions over streams: an extension, for clips that arrive one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_takes(clips: DataFrame, gap: str, late: str, key: list[str], time: str = "ts") -> DataFrame:
    """Takes by the pure gap rule: ``key, take_start, last_seen, clips``.

    Session windows close once the watermark passes; clips later than ``late`` are dropped by it.  Works on streams
    and, with the watermark ignored, on tables.
    """
    sessions = clips.withWatermark(time, late).groupBy(*key, F.session_window(time, gap).alias("w"))
    return sessions.agg(F.min(time).alias("take_start"), F.max(time).alias("last_seen"), F.count("*").alias("clips")).drop("w")


def label_changes(clips: DataFrame, late: str, key: list[str], window: str, time: str = "ts", label: str = "label") -> DataFrame:
    """Counts by label in tumbling windows, as input of a running prior."""
    return clips.withWatermark(time, late).groupBy(*key, F.window(time, window), label).agg(F.count("*").alias("n"))
