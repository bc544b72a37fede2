"""Row filters on text: loops, stock phrases, anomalies, duplicate runs, selection of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from cuelight.functions.text import folded, normalised, squeeze, trimmed

#: Fixed values of the loop rules.
LEAST_CHARS, MOST_DISTINCT, LONG_RUN, UNIT_TIMES, UNIT_SPAN, UNIT_SIZE = 12, 2, 8, 4, 12, 6
#: Characters that the two detectors' unit scans look at.
SCAN, SCORE_SCAN = 4000, 600
#: Stock phrases, in the order in which they are tried.
PHRASES = (
    "ご視聴ありがとうございました",
    "ご視聴ありがとうございます",
    "チャンネル登録をお願いいたします",
    "영상편집및자막이도움이되셨다면구독좋아요댓글부탁드립니다",
    "다음영상에서만나요",
    "시청해주셔서감사합니다",
    "구독과좋아요부탁드립니다",
)
#: Characters beside a phrase that still leave it whole.
SLACK = 2
#: Fixed values of the anomalies, in milliseconds, characters a second and characters.
OVER_MS, THIN_MS, THIN_RATE, DENSE_MS, DENSE_RATE, DENSE_CHARS = 30_000, 20_000, 1, 50, 15, 20


def distinct_rule(text: Column) -> Column:
    """A long text of almost no distinct characters."""
    return (F.length(text) >= LEAST_CHARS) & (F.size(F.array_distinct(F.split(text, ""))) <= MOST_DISTINCT)


def run_rule(text: Column) -> Column:
    """One character held down."""
    return text.rlike(f"(?s)(.)\\1{{{LONG_RUN - 1}}}")


def repeats(text: str, limit: int, by_span: bool) -> tuple[int, int]:
    """Count and span of the strongest run of one repeated unit: the widest one, or the one of most repetitions.

    The scan of a unit size goes on after a run that it has found, so runs that are offset into one are not seen; both
    detectors are defined by that.
    """
    t = text[:limit]
    best = (1, 0)
    for size in range(1, UNIT_SIZE + 1):
        at = 0
        while at + 2 * size <= len(t):
            unit, end = t[at : at + size], at + size
            while t.startswith(unit, end):
                end += size
            count = (end - at) // size
            if count > 1:
                if (count * size > best[1]) if by_span else (count > best[0]):
                    best = (count, count * size)
                at = end
            else:
                at += 1
    return best


@F.pandas_udf(StructType([StructField("count", IntegerType()), StructField("span", IntegerType())]))
def widest_repeat(text: pd.Series) -> pd.DataFrame:
    """Count and span of the repeated unit that covers most."""
    return pd.DataFrame([repeats(t or "", SCAN, True) for t in text], columns=["count", "span"])


@F.pandas_udf(IntegerType())
def most_repeats(text: pd.Series) -> pd.Series:
    """The most repetitions of one unit."""
    return text.map(lambda t: repeats(t or "", SCORE_SCAN, False)[0])


def loops(segments: DataFrame, text: str = "text") -> DataFrame:
    """``segments`` with ``loop``, the first rule of the production detector that fires, or null: 'distinct', 'run', 'unit'."""
    rows = segments.withColumn("__f", folded(F.coalesce(F.col(text), F.lit("")))).withColumn("__u", widest_repeat("__f"))
    unit = (F.col("__u.count") >= UNIT_TIMES) & (F.col("__u.span") >= UNIT_SPAN)
    why = F.when(distinct_rule(F.col("__f")), "distinct").when(run_rule(F.col("__f")), "run").when(unit, "unit")
    return rows.withColumn("loop", why).withColumn("folded_chars", F.length("__f")).drop("__f", "__u")


def score_loops(segments: DataFrame, text: str = "text") -> DataFrame:
    """``segments`` with ``loop`` (boolean) of the scoring detector, on text at the plain level."""
    rows = segments.withColumn("__p", normalised(F.coalesce(F.col(text), F.lit("")), "plain"))
    rule = distinct_rule(F.col("__p")) | run_rule(F.col("__p")) | (most_repeats("__p") >= UNIT_TIMES)
    return rows.withColumn("loop", rule & (F.col("__p") != "")).withColumn("plain_chars", F.length("__p")).drop("__p")


def phrases(segments: DataFrame, text: str = "text", fold: bool = True) -> DataFrame:
    """``segments`` with ``phrase``, the first stock phrase that the folded text holds, and ``whole``, whether it is all of it."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = segments.withColumn("__f", folded(t) if fold else squeeze(t))
    first = F.coalesce(*(F.when(F.contains(F.col("__f"), F.lit(p)), p) for p in PHRASES))
    rows = rows.withColumn("phrase", first)
    return rows.withColumn("whole", F.col("phrase").isNotNull() & (F.length("__f") <= F.length("phrase") + SLACK)).drop("__f")


def anomalies(segments: DataFrame, chars: Column) -> DataFrame:
    """``segments`` (a, b in milliseconds) with ``over30``, ``thin``, ``dense`` and ``rate`` (characters a second, null if short)."""
    ms = F.greatest(F.lit(0), F.col("b") - F.col("a"))
    rows = segments.withColumn("ms", ms).withColumn("chars", chars)
    rows = rows.withColumn("over30", F.col("ms") > OVER_MS).withColumn("thin", (F.col("ms") >= THIN_MS) & (F.col("chars") * 1000 < THIN_RATE * F.col("ms")))
    counted = (F.col("ms") >= DENSE_MS) & (F.col("chars") > 0)
    rows = rows.withColumn("dense", counted & (F.col("chars") * 1000 > DENSE_RATE * F.col("ms")) & (F.col("chars") >= DENSE_CHARS))
    return rows.withColumn("rate", F.when(counted, F.col("chars") * 1000 / F.col("ms")))


def repeated_runs(segments: DataFrame, keys: list[str], order: list[str], text: str = "text", id_col: str = "seg_id") -> DataFrame:
    """(``id_col``, ``kept``): the stateful filter of consecutive duplicates.

    A text repeats if it equals the last text that did not repeat, or is over ten characters of at most two kinds after any
    text; the first repetition is kept, later ones are dropped. The fold is sequential, so a recording's rows are sorted
    within one partition, and the state is all that is held of it.
    """
    rows = segments.select(*keys, *order, id_col, trimmed(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = StructType([StructField(id_col, LongType()), StructField("kept", BooleanType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last, times = None, "", 0
        for b in batches:
            out = []
            for k, t in zip(b[keys].itertuples(index=False, name=None), b["__t"]):
                if k != key:
                    key, last, times = k, "", 0
                bare = t.replace(" ", "").replace("　", "")
                if t and last and (t == last or (len(bare) > 10 and len(set(bare)) <= 2)):
                    times += 1
                else:
                    times, last = 0, t
                out.append(times < 2)
            yield pd.DataFrame({id_col: b[id_col], "kept": out})

    return rows.mapInPandas(fold, schema)


def selected(rows: DataFrame, column: str, only: list[str], exclude: list[str]) -> DataFrame:
    """Rows whose name holds any of ``only`` (if there are any) and then none of ``exclude``."""
    for names, keep in ((only, True), (exclude, False)):
        if names:
            hit = F.lit(False)
            for n in names:
                hit = hit | F.contains(F.col(column), F.lit(n))
            rows = rows.where(hit if keep else ~hit)
    return rows


#: Labels of a segmenter that are speech.
SPEECH_LABELS = ("speech", "male", "female")


def labelled(regions: DataFrame, label: str, labels: tuple[str, ...] = SPEECH_LABELS) -> DataFrame:
    """The regions of one of the labels; those of a null label are none."""
    return regions.where(F.col(label).isin(list(labels)))


def first_delivery(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order; ties are broken by the order's columns only."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
