"""Caption files with control codes into cues."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Fixed patterns of the format: times, voices, control blocks, glyphs, sizes, clear-screen.
TIME = r"(?:\d{1,3}:\d{2}:\d{2}|\d{1,2}:\d{2})[.,]\d{1,3}"
TIMING = re.compile(rf"({TIME})\s*-->\s*({TIME})")
VOICE = re.compile(r"<v\b[^>]*>(.*?)</v>", re.S)
CONTROL = re.compile(r"<c>(.*?)</c>", re.S)
TAG = re.compile(r"</?[A-Za-z][^>]*>")
GLYPH = re.compile(r"%\+\{.*?%\+\}", re.S)
SIZE = re.compile(r"%\^([HIJ])")
CLEAR = "%0C"
RUBY_SIZE = "H"

CUE = StructType(
    [
        StructField("stem", StringType()),
        StructField("pos", LongType()),
        StructField("start_s", DoubleType()),
        StructField("end_s", DoubleType()),
        StructField("text", StringType()),
        StructField("ruby", ArrayType(StringType())),
        StructField("drcs", IntegerType()),
        StructField("cleared", BooleanType()),
    ]
)


def seconds(stamp: str) -> float:
    """Seconds of ``HH:MM:SS.mmm`` or ``MM:SS.mmm``, with a point or a comma."""
    total = 0.0
    for part in stamp.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def voice(body: str) -> tuple[str, list[str], int, bool]:
    """Text, ruby, glyph count and clear flag of one voice. The last size control before a run tells whether it is ruby; the
    size is normal again in the next voice."""
    text, ruby, glyphs, cleared, small = [], [], 0, False, False
    for k, part in enumerate(CONTROL.split(body)):
        if k % 2:
            glyphs += len(GLYPH.findall(part))
            cleared |= CLEAR in part
            sizes = SIZE.findall(part)
            small = sizes[-1] == RUBY_SIZE if sizes else small
        elif part:
            (ruby if small else text).append(TAG.sub("", part) if small else part)
    return TAG.sub("", "".join(text)), [r for r in ruby if r.strip()], glyphs, cleared


def cues(document: str) -> Iterator[dict]:
    """The cues of a file: a line with a timing, and the lines up to the next blank one. A body without voices is one."""
    lines = document.removeprefix("﻿").splitlines()
    k = 0
    while k < len(lines):
        timing = TIMING.search(lines[k])
        k += 1
        if not timing:
            continue
        first = k
        while k < len(lines) and lines[k].strip():
            k += 1
        body = "\n".join(lines[first:k])
        parts = [voice(v) for v in VOICE.findall(body) or [body]]
        yield {
            "start_s": seconds(timing[1]),
            "end_s": seconds(timing[2]),
            "text": "\n".join(t for t, *_ in parts if t.strip()),
            "ruby": [r for _, ruby, *_ in parts for r in ruby],
            "drcs": sum(p[2] for p in parts),
            "cleared": any(p[3] for p in parts),
        }


def read_captions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The cues of all caption files under the roots ``paths``; of files of one stem, that of the first root, then path."""
    files = None
    for n, root in enumerate(paths):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[vV][tT][tT]").load(root)
        found = found.select(F.lit(n).alias("root"), "path", "content")
        files = found if files is None else files.unionByName(found)
    files = files.withColumn("stem", F.regexp_replace(F.element_at(F.split("path", "/"), -1), "(?i)\\.vtt$", ""))
    first = Window.partitionBy("stem").orderBy("root", "path")
    chosen = files.select("root", "path", "stem").withColumn("n", F.row_number().over(first)).where("n = 1").select("root", "path")
    files = files.join(chosen, ["root", "path"], "left_semi").select("stem", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for stem, content in zip(b["stem"], b["content"]):
                rows = [{"stem": stem, "pos": i, **c} for i, c in enumerate(cues(content.decode("utf-8", "replace")))]
                yield pd.DataFrame(rows, columns=CUE.names)

    return files.mapInPandas(parse, CUE)


def duplicate_stems(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(``stem``, ``files``): stems that more than one file has."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[vV][tT][tT]").load(paths)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "(?i)\\.vtt$", "")
    return files.groupBy(stem.alias("stem")).agg(F.count("*").alias("files")).where("files > 1")
