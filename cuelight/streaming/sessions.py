"""Speech sessions over a stream of voiced frames: a silence ends one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def speech_sessions(frames: DataFrame, keys: list[str], time: str = "at", voiced: str = "voiced", silence: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """(keys, start, end, frames): sessions of voiced frames that no silence of ``silence`` parts. Frames that are later than
    ``late`` behind the newest are dropped. It has no hysteresis; the batch operator has."""
    rows = frames.withWatermark(time, late).where(F.col(voiced))
    rows = rows.groupBy(*keys, F.session_window(time, silence)).agg(F.count("*").alias("frames"))
    return rows.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "frames")
