"""Segments into subtitle and text files: one expression for a segment's part, one file a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.functions.text import one_line, timestamp, trimmed

#: The formats by name with their suffixes; ``all`` is every one of them, ``text`` another name of ``txt``.
SUFFIX = {"srt": ".srt", "vtt": ".vtt", "txt": ".txt", "tsv": ".tsv", "lrc": ".lrc", "json": ".json"}
HEADERS = {"vtt": "WEBVTT\n\n", "tsv": "start\tend\ttext\n"}


def formats(names: list[str]) -> list[str]:
    """The formats that are asked for, each once, in order; unknown ones are left out."""
    wide = [n for x in names for n in (list(SUFFIX) if x == "all" else ["txt" if x == "text" else x])]
    return [n for n in dict.fromkeys(wide) if n in SUFFIX]


def _seconds(ms: Column) -> Column:
    return F.format_string("%d.%03d", F.floor(ms / 1000).cast("bigint"), (ms % 1000).cast("bigint"))


def part(kind: str, number: Column, a: Column, b: Column, text: Column) -> Column:
    """The text of one segment in a format. Times are milliseconds; the seconds of lrc are rounded to hundredths without a carry."""
    line = one_line(text)
    if kind in ("srt", "vtt"):
        sep = "," if kind == "srt" else "."
        return F.concat(number.cast("string"), F.lit("\n"), timestamp(a, sep), F.lit(" --> "), timestamp(b, sep), F.lit("\n"), trimmed(text), F.lit("\n\n"))
    if kind == "txt":
        return F.concat(line, F.lit("\n"))
    if kind == "tsv":
        return F.concat_ws("\t", _seconds(a), _seconds(b), F.concat(line, F.lit("\n")))
    if kind == "lrc":
        hundredths = F.floor(((a % 60000) + 5) / 10).cast("bigint")
        return F.format_string("[%02d:%02d.%02d]%s\n", F.floor(a / 60000).cast("bigint"), F.floor(hundredths / 100).cast("bigint"), (hundredths % 100).cast("bigint"), line)
    raise ValueError(f"unknown format {kind!r}")


def parts(segments: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, seg_id, number, part) of segments (keys, seg_id, pos, a, b, text), numbered from 1 in each recording."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "seg_id"))
    rows = segments.withColumn("number", number)
    return rows.select(*keys, "seg_id", "number", part(kind, F.col("number"), F.col("a"), F.col("b"), F.coalesce("text", F.lit(""))).alias("part"))


def documents(segments: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, document): the whole file of each recording; a recording fits a task, as the file does."""
    rows = F.array_sort(F.collect_list(F.struct("number", "part")))
    whole = parts(segments, keys, kind).groupBy(*keys).agg(rows.alias("r"))
    return whole.select(*keys, F.concat(F.lit(HEADERS.get(kind, "")), F.array_join(F.transform("r", lambda x: x["part"]), "")).alias("document"))


def json_documents(segments: DataFrame, information: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document): the JSON file of each recording: language, duration and segments with words and probabilities.

    ``segments`` has keys, pos, seg_id, id, start_s, end_s, text, and if they are there no_speech_prob, avg_logprob, words;
    ``information`` has keys, language, duration, one row a recording. Times have three decimals, probabilities four; what a
    segment lacks is left out, a missing language is empty and a missing duration 0.
    """
    fields = [F.col("id").cast("bigint").alias("id"), F.round(F.coalesce("start_s", F.lit(0.0)), 3).alias("start"), F.round(F.coalesce("end_s", "start_s", F.lit(0.0)), 3).alias("end"), F.coalesce("text", F.lit("")).alias("text")]
    fields += [F.round(c, 4).alias(c) for c in ("no_speech_prob", "avg_logprob") if c in segments.columns]
    if "words" in segments.columns:
        words = F.transform("words", lambda w: F.struct(w["word"].alias("word"), F.round(w["start_s"], 3).alias("start"), F.round(w["end_s"], 3).alias("end"), F.round(w["probability"], 4).alias("probability")))
        fields.append(F.when(F.size("words") > 0, words).alias("words"))
    rows = segments.select(*keys, F.struct("pos", "seg_id").alias("__at"), F.struct(*fields).alias("__s"))
    # in the order of the places only: a segment's fields need no order
    own = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__s")), lambda x, y: F.when(x["__at"] < y["__at"], -1).when(x["__at"] > y["__at"], 1).otherwise(0)), lambda x: x["__s"])
    rows = rows.groupBy(*keys).agg(own.alias("segments")).join(information, keys, "left")
    whole = F.struct(F.coalesce("language", F.lit("")).alias("language"), F.round(F.coalesce("duration", F.lit(0.0)), 3).alias("duration"), "segments")
    return rows.select(*keys, F.to_json(whole, {"pretty": "true"}).alias("document"))


def output_files(names: DataFrame, wanted: list[str]) -> DataFrame:
    """``names`` (base) once for each format that is asked for, with ``kind`` and ``file``, in the order of writing (``n``)."""
    kinds = F.array(*(F.struct(F.lit(i).alias("n"), F.lit(k).alias("kind"), F.lit(SUFFIX[k]).alias("suffix")) for i, k in enumerate(formats(wanted))))
    return names.withColumn("x", F.explode(kinds)).select(*names.columns, "x.n", "x.kind", F.concat("base", "x.suffix").alias("file"))


def write(segments: DataFrame, keys: list[str], names: list[str], folder: str, information: DataFrame | None = None) -> list[str]:
    """Writes each format under ``folder``/format, partitioned by recording; the committer makes it all or nothing. ``segments``
    and ``information`` for JSON are as ``json_documents`` takes them; without ``information`` nothing is known of the recordings."""
    written = []
    for kind in formats(names):
        path = f"{folder}/{kind}"
        if kind == "json":
            known = segments.select(*keys).distinct().withColumns({"language": F.lit(""), "duration": F.lit(0.0)}) if information is None else information
            timed = segments if "start_s" in segments.columns else segments.withColumns({"start_s": F.col("a") / 1000, "end_s": F.col("b") / 1000})
            rows = json_documents(timed, known, keys)
        else:
            rows = documents(segments, keys, kind)
        rows = rows.select(*keys, F.regexp_replace("document", "\\n\\z", "").alias("value"))  # the writer ends it
        rows.write.mode("overwrite").partitionBy(*keys).text(path)
        written.append(path)
    return written
