"""Measurements of sound stages as rows: levels read from a log, and the checks of a chain of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The level at which a file counts as silent, and the share by which a length may drift.
SILENT_DB, DRIFT = -80.0, 0.02


def _level(name: str) -> Column:
    found = F.regexp_extract("log", f"{name}:\\s*(-?[0-9.]+|-?inf)\\s*dB", 1)
    return F.when(found.isin("", "-inf"), F.lit(float("-inf"))).otherwise(found.cast("double"))


def levels(logs: DataFrame) -> DataFrame:
    """``logs`` (..., log) with peak_db, mean_db (minus infinity where the log has none) and seconds (null where it has none)."""
    h, m, s = (F.regexp_extract("log", r"Duration:\s*(\d+):(\d+):([0-9.]+)", i) for i in (1, 2, 3))
    seconds = F.when(h != "", F.expr("0.0") + h.cast("int") * 3600 + m.cast("int") * 60 + s.cast("double"))
    return logs.withColumn("peak_db", _level("max_volume")).withColumn("mean_db", _level("mean_volume")).withColumn("seconds", seconds)


def stage_faults(stages: DataFrame, keys: list[str]) -> DataFrame:
    """``stages`` (keys, stage, peak_db, seconds, may_stretch) with ``fault``: 'silent' if a stage left no sound, 'drift' if its
    length left the one before by more than DRIFT though it may not, else null."""
    before = F.lag("seconds").over(Window.partitionBy(*keys).orderBy("stage"))
    rows = stages.withColumn("__before", before)
    drift = (~F.col("may_stretch")) & (F.abs(F.col("seconds") - F.col("__before")) > DRIFT * F.col("__before"))
    return rows.withColumn("fault", F.when(F.col("peak_db") <= SILENT_DB, "silent").when(drift, "drift")).drop("__before")
