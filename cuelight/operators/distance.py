"""String distances and the error scores that are summed from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cuelight.functions.text import LEVELS, normalised


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word a bit for each character of ``a``."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & place.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def edits(a: str, b: str) -> int:
    """Edit distance of two strings, one bit of a whole number for each character of the longer one."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        same = place.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(across | up)), up & across
        score += 1 if rise & top else -1 if fall & top else 0
        rise, fall = ((rise << 1) | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
    return score


@F.pandas_udf(LongType())
def edit_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two columns of long texts, always exact; null where either is."""
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b)], dtype="Int64")


@F.pandas_udf(LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two columns; null where either is."""
    return pd.Series([None if x is None or y is None else common_length(x, y) for x, y in zip(a, b)], dtype="Int64")


def pair_scores(pairs: DataFrame, reference: Column, hypothesis: Column, common: bool = True, long: bool = False) -> DataFrame:
    """``pairs`` with ref_chars, hyp_chars, edits and matches. An empty reference has characters of the hypothesis only. The
    built-in distance is the faster one for lines, that of whole numbers for whole files (``long``); both are exact."""
    rows = pairs.withColumn("__r", F.coalesce(reference, F.lit(""))).withColumn("__h", F.coalesce(hypothesis, F.lit("")))
    there = F.col("__r") != ""
    distance = edit_length("__r", "__h") if long else F.levenshtein("__r", "__h")
    rows = rows.withColumn("ref_chars", F.length("__r").cast("bigint")).withColumn("hyp_chars", F.length("__h").cast("bigint"))
    rows = rows.withColumn("edits", F.when(there, distance).otherwise(0).cast("bigint"))
    rows = rows.withColumn("matches", lcs_length("__r", "__h") if common else F.lit(0).cast("bigint"))
    return rows.withColumn("empty_ref", (~there).cast("bigint")).drop("__r", "__h")


def rolled_up(scores: DataFrame, outer: list[str], inner: list[str]) -> DataFrame:
    """Sums for every file and for all files of ``outer`` (``total`` = 1), with the ratios made from the sums."""
    sums = {c: F.sum(c) for c in ("ref_chars", "hyp_chars", "edits", "matches", "empty_ref")}
    whole = [F.col(c) for c in (*outer, *inner)]
    rows = scores.groupingSets([whole, [F.col(c) for c in outer]], *whole).agg(F.count("*").alias("blocks"), *(x.alias(c) for c, x in sums.items()), F.grouping(inner[0]).cast("int").alias("total"))

    def ratio(x: str, y: str) -> Column:
        return F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)

    return rows.withColumns({"cer": ratio("edits", "ref_chars"), "coverage": ratio("matches", "ref_chars"), "precision": ratio("matches", "hyp_chars"), "length_ratio": ratio("hyp_chars", "ref_chars")})


def levels(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``pairs`` once for each level, with both texts at it."""
    def at_levels(column: str) -> Column:
        text = F.coalesce(F.col(column), F.lit(""))
        return F.array(*(normalised(text, level) for level in LEVELS))

    rows = pairs.withColumns({"__r": at_levels(reference), "__h": at_levels(hypothesis)}).withColumn("__i", F.explode(F.lit(list(range(len(LEVELS))))))
    rows = rows.withColumn("level", F.lit(list(LEVELS))[F.col("__i")]).withColumns({reference: F.col("__r")[F.col("__i")], hypothesis: F.col("__h")[F.col("__i")]})
    return rows.drop("__r", "__h", "__i")


def diagnosis(coverage: Column, precision: Column) -> Column:
    """What dominates an error: missed speech, invention, both, or neither."""
    lost, made = 1 - coverage, 1 - precision
    return F.when((lost < 0.05) & (made < 0.05), "close").when(lost > made * 1.5, "missed").when(made > lost * 1.5, "invention").otherwise("both")
