"""The tables as the operators take them: each row once, times in whole milliseconds, missing texts empty; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelight.functions.text import SPACE
from cuelight.session import table

REEL = ["stem", "reel"]
TAKE = ["config", "stem", "reel"]


def ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("bigint")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """seg_id, config, stem, reel, pos, id, a, b, text: a missing start is 0, a missing end the start."""
    s = table(spark, d, "segments").dropDuplicates(["seg_id"])
    a = F.coalesce("start_s", F.lit(0.0))
    return s.select("seg_id", *TAKE, "pos", "id", ms(a).alias("a"), ms(F.coalesce("end_s", a)).alias("b"), F.coalesce("text", F.lit("")).alias("text"))


def worded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").dropDuplicates(["seg_id"])


def cues(spark: SparkSession, d: str) -> DataFrame:
    """cue_id, stem, reel, pos, a, b, text, ruby, drcs, cleared."""
    c = table(spark, d, "cues").dropDuplicates(["cue_id"])
    return c.select("cue_id", *REEL, "pos", ms(F.col("start_s")).alias("a"), ms(F.col("end_s")).alias("b"), F.coalesce("text", F.lit("")).alias("text"), "ruby", "drcs", "cleared")


def regions(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "regions")
    return r.select("backend", *REEL, ms(F.col("start_s")).alias("a"), ms(F.col("end_s")).alias("b"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """stem, idx, p: a probability track in hundredths, made of the events of a user in time order."""
    e = table(spark, d, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("stem"), idx.cast("bigint").alias("idx"), ((F.col("event_id") * 37) % 100).alias("p"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    """stem, reel, total: the longest known duration of a reel in milliseconds."""
    t = table(spark, d, "transcripts").where("duration is not null")
    return t.groupBy(*REEL).agg(ms(F.max("duration")).alias("total"))


#: SQL of the same.
SEG = """seg as (select distinct seg_id, config, stem, reel, pos, id, cast(round(coalesce(start_s, 0) * 1000) as bigint) a,
 cast(round(coalesce(end_s, start_s, 0) * 1000) as bigint) b, coalesce(text, '') text from segments)"""
CUE = """cue as (select distinct cue_id, stem, reel, pos, cast(round(start_s * 1000) as bigint) a, cast(round(end_s * 1000) as bigint) b,
 coalesce(text, '') text, ruby, drcs, cleared from cues)"""
REG = "reg as (select backend, stem, reel, cast(round(start_s * 1000) as bigint) a, cast(round(end_s * 1000) as bigint) b from regions)"
FRM = "frm as (select user_id stem, row_number() over (partition by user_id order by ts, event_id) - 1 idx, event_id * 37 % 100 p from events)"
#: The white space of the engine, for a character class in DuckDB's patterns.
WS = SPACE.replace("\\", "\\\\")
BARE = "regexp_replace({0}, '[" + WS + "]+', '', 'g')"
SPOKEN = (
    "spoken as (select *, " + BARE.format("text") + " <> '' has_text, case when " + BARE.format("text") + " <> '' then"
    " least(b, a + least(20000, greatest(2000, length(" + BARE.format("text") + ") * 1200))) else b end speech_end from cue)"
)


def merged(source: str, keys: str, name: str = "mrg", where: str = "a < b") -> str:
    """SQL of the union of spans (keys, a, b) of ``source``; equal spans count once, as two windows may take ties in two orders."""
    over = f"over (partition by {keys} order by a, b"
    return f"""{name}0 as (select {keys}, a, b, max(b) {over} rows between unbounded preceding and 1 preceding) m from (select distinct {keys}, a, b from {source} where {where})),
{name}1 as (select *, sum(case when m is null or a > m then 1 else 0 end) {over} rows unbounded preceding) k from {name}0),
{name} as (select {keys}, min(a) a, max(b) b from {name}1 group by {keys}, k)"""
