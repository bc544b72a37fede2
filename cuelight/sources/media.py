"""Lists of media files, and what is still to be done. Listing is work of the driver; rows come from it as a DataFrame."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of media files and of play lists.
MEDIA = (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".mp3", ".wav", ".flac", ".aac", ".m4a", ".ogg", ".wma", ".ts", ".m2ts", ".mts")
LISTS = (".txt", ".m3u", ".m3u8", ".lst")


def collect(paths: list[str], recursive: bool = False) -> list[str]:
    """Media files of files, patterns, folders (if ``recursive``, sorted) and play lists, in order, repeats kept. Lines of a
    play list that are blank or begin with # are skipped; anything else is ignored."""
    out: list[str] = []
    for p in paths:
        for item in sorted(glob.glob(p)) or [p]:
            suffix = os.path.splitext(item)[1].lower()
            if os.path.isdir(item):
                if recursive:
                    inside = (os.path.join(d, f) for d, _, fs in os.walk(item) for f in fs)
                    out += sorted(f for f in inside if os.path.splitext(f)[1].lower() in MEDIA)
            elif suffix in LISTS and os.path.isfile(item):
                with open(item, encoding="utf-8", errors="ignore") as f:
                    out += [x for x in map(str.strip, f) if x and not x.startswith("#")]
            elif suffix in MEDIA and os.path.isfile(item):
                out.append(item)
    return out


def listed(spark: SparkSession, paths: list[str], recursive: bool = False, check: bool = False) -> DataFrame:
    """(pos, path, stem) of ``collect``; with ``check``, existing files only."""
    files = [f for f in collect(paths, recursive) if not check or os.path.isfile(f)]
    rows = [(i, f, os.path.splitext(os.path.basename(f))[0]) for i, f in enumerate(files)]
    return spark.createDataFrame(rows, "pos bigint, path string, stem string")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str], redo: bool = False) -> DataFrame:
    """What is wanted and not done yet; all of it with ``redo``."""
    return wanted if redo else wanted.join(done.select(*keys).distinct(), keys, "left_anti")
