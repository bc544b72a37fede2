"""Frames of speech probability into runs of speech, by windows only.

The hysteresis needs no loop where the lower threshold is at most the upper one: frames are grouped by the count of peaks so
far, and a group breaks the run if its low frames last long enough, counted from the first; runs are islands of groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(frames: DataFrame, keys: list[str], value: str, upper: float, lower: float | None, silence: int, step: int = 256) -> DataFrame:
    """(keys, a, b, total) in samples: a run opens at ``value >= upper`` and closes at the first ``value < lower`` that no peak
    follows before ``silence`` samples have passed; an open run ends with the track.

    ``frames`` has keys, idx (from 0 without holes) and the value; ``lower`` defaults to the upper less 0.15, 0.01 at least.
    """
    lower = max(upper - 0.15, 0.01) if lower is None else lower
    if lower > upper:
        raise ValueError("the lower threshold must not exceed the upper one")
    by = Window.partitionBy(*keys).orderBy("idx")
    rows = frames.withColumn("__g", F.count_if(F.col(value) >= upper).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__total", F.count("*").over(Window.partitionBy(*keys)) * step)
    low = F.col(value) < lower
    groups = rows.where("__g > 0").groupBy(*keys, "__g").agg(
        F.min("idx").alias("first"), F.min(F.when(low, F.col("idx"))).alias("f"), F.max(F.when(low, F.col("idx"))).alias("l"), F.first("__total").alias("total")
    )
    broke = F.coalesce((F.col("l") - F.col("f")) * step >= silence, F.lit(False))
    order = Window.partitionBy(*keys).orderBy("__g")
    groups = groups.withColumn("broke", broke).withColumn("opens", F.coalesce(F.lag("broke").over(order), F.lit(True)))
    groups = groups.withColumn("run", F.count_if("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = groups.groupBy(*keys, "run").agg(
        (F.min("first") * step).alias("a"), F.coalesce(F.max(F.when(F.col("broke"), F.col("f") * step)), F.first("total")).alias("b"), F.first("total").alias("total")
    )
    return out.drop("run")


def smoothed_flags(flags: DataFrame, keys: list[str], flag: str, pad: int, speech: int, silence: int) -> DataFrame:
    """(keys, a, b) in frames: runs of a boolean track. A run starts ``pad`` frames early, closes at the ``silence``-th silent
    frame and lasts ``pad`` frames longer; shorter ones than ``speech`` are dropped, but not a run that is open at the end."""
    ends = flags.groupBy(*keys).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys).orderBy("idx")
    on = flags.where(F.col(flag)).withColumn("fresh", F.coalesce(F.col("idx") - F.lag("idx").over(by) > silence, F.lit(True)))
    on = on.withColumn("run", F.count_if("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = on.groupBy(*keys, "run").agg(F.min("idx").alias("x"), F.max("idx").alias("y")).join(ends, keys)
    rows = rows.withColumn("a", F.greatest(F.lit(0), F.col("x") - pad)).withColumn("open", F.col("y") + silence >= F.col("n"))
    rows = rows.withColumn("b", F.when(F.col("open"), F.col("n")).otherwise(F.least("n", F.col("y") + silence + pad)))
    return rows.where((F.col("b") - F.col("a") >= speech) | F.col("open")).select(*keys, "a", "b")
