"""JSON transcripts, third-party transcripts and region files into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "struct<word:string,start:double,end:double,probability:double>"
SEGMENT = f"struct<id:bigint,start:double,end:double,text:string,no_speech_prob:double,avg_logprob:double,words:array<{WORD}>>"
FILE = f"language string, duration double, segments array<{SEGMENT}>"


def _stem(suffix: str) -> F.Column:
    return F.regexp_replace(F.element_at(F.split(F.col("path"), "/"), -1), suffix, "")


def read_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, language, duration, segments): one row a file; what is missing is null."""
    return spark.read.schema(FILE).option("multiLine", "true").option("mode", "PERMISSIVE").json(paths).withColumn("path", F.input_file_name())


def read_transcripts(spark: SparkSession, paths: list[str] | str, config: str) -> DataFrame:
    """Segments of files: missing texts are empty, missing starts 0, missing ends the start; in the order of the starts, equal
    ones as delivered."""
    rows = read_files(spark, paths).select(F.lit(config).alias("config"), _stem(r"\.json$").alias("stem"), F.posexplode("segments").alias("n", "s"))
    start = F.coalesce("s.start", F.lit(0.0))
    by = Window.partitionBy("config", "stem").orderBy("start_s", "n")
    rows = rows.select("config", "stem", "n", "s.id", start.alias("start_s"), F.coalesce("s.end", start).alias("end_s"), F.coalesce("s.text", F.lit("")).alias("text"), "s.no_speech_prob", "s.avg_logprob", "s.words")
    return rows.withColumn("pos", (F.row_number().over(by) - 1).cast("bigint")).drop("n")


def read_third_party(spark: SparkSession, paths: list[str] | str, twins: DataFrame) -> DataFrame:
    """Transcripts of other tools: texts and words are stripped, an id that is missing or 0 becomes the place from 1, the
    duration is the file's or its twin's (stem, duration); files without any are left out."""
    rows = read_files(spark, paths).withColumn("stem", _stem(r"\.json$")).join(twins.withColumnRenamed("duration", "twin"), "stem", "left")
    rows = rows.withColumn("duration", F.coalesce("duration", "twin")).where("duration is not null")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    segment = F.transform(
        "segments",
        lambda s, i: F.struct(
            F.when(F.coalesce(s["id"], F.lit(0)) == 0, i + 1).otherwise(s["id"]).cast("bigint").alias("id"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            strip(s["text"]).alias("text"),
            F.transform(s["words"], lambda w: F.struct(strip(w["word"]).alias("word"), w["start"].alias("start"), w["end"].alias("end"), w["probability"].alias("probability"))).alias("words"),
        ),
    )
    return rows.select("stem", "language", "duration", segment.alias("segments"))


def read_regions(spark: SparkSession, path: str, stems: list[str] | None = None) -> DataFrame:
    """(stem, start_s, end_s) of a region file ``{stem: [[start, end], ...]}``; a stem that is asked for and missing is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<array<double>>>").alias("m"))
    if stems is not None:
        for s in stems:
            whole = whole.withColumn("m", F.when(F.map_contains_key("m", s), F.col("m")).otherwise(F.raise_error(F.lit(f"no regions of {s!r}"))))
    rows = whole.select(F.explode("m").alias("stem", "spans")).select("stem", F.explode("spans").alias("s"))
    rows = rows.select("stem", F.col("s")[0].alias("start_s"), F.col("s")[1].alias("end_s"))
    return rows if stems is None else rows.where(F.col("stem").isin(stems))


def write_regions(regions: DataFrame, path: str) -> None:
    """The regions (stem, start_s, end_s) as JSON lines of one stem each, in the order of time."""
    spans = F.array_sort(F.collect_list(F.array(F.round("start_s", 3), F.round("end_s", 3))))
    rows = regions.groupBy("stem").agg(spans.alias("spans"))
    rows.select(F.to_json(F.create_map("stem", "spans")).alias("value")).write.mode("overwrite").text(path)
