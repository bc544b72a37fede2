"""Scores of recogniser output against captions: gaps, blocks, differences of configurations, the caption survey."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cuelight.functions.text import MUSIC, SPACE, budget_ms, squeeze, sung, trimmed
from cuelight.operators.intervals import holes, merge, points_in, subtract
from cuelight.session import cut

#: Milliseconds between two captions that part blocks.
PART_MS = 2000
#: Labels that the survey reads, in brackets or before a colon.
BRACKET_LABEL = f"^[（(][{SPACE}]*([^）)]{{1,14}})[{SPACE}]*[）)]"
COLON_LABEL = f"^([^{SPACE}:：（）()]{{1,10}})[:：]"


def speech_spans(cues: DataFrame) -> DataFrame:
    """``cues`` (a, b, text) with has_text, speech_end, speech_ms, screen_ms and held_ms, all in milliseconds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cues.withColumn("has_text", squeeze(text) != "")
    rows = rows.withColumn("speech_end", F.when(F.col("has_text"), F.least("b", F.col("a") + budget_ms(text))).otherwise(F.col("b")))
    zero = F.lit(0).cast("bigint")
    return rows.withColumns({"speech_ms": F.greatest(zero, F.col("speech_end") - F.col("a")), "screen_ms": F.greatest(zero, F.col("b") - F.col("a")), "held_ms": F.greatest(zero, F.col("b") - F.col("speech_end"))})


def caption_gaps(cues: DataFrame, keys: list[str], minimum: int = 20_000, totals: DataFrame | None = None) -> DataFrame:
    """(keys, a, b): stretches over ``minimum`` in which no caption speaks, from 0 on, up to ``total`` if given."""
    spans = speech_spans(cues).where("has_text").select(*keys, "a", F.col("speech_end").alias("b"))
    return holes(merge(spans, keys), keys, minimum, totals)


def gap_hits(segments: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """The segments whose middle lies in a gap; gaps are disjoint, so each has at most one."""
    return points_in(segments, gaps, keys, F.col("a") + F.col("b"))


def blocks(cues: DataFrame, keys: list[str], seconds: int = 30, skip_music: bool = True, skip_songs: bool = False) -> DataFrame:
    """(keys, block, a, b, reference): consecutive captions joined until a block is ``seconds`` long.

    A caption without text, with music (and songs, if wanted), or over two seconds after the speech before it starts anew.
    Where a block ends decides where the next one starts, so the fold is sequential: a recording's captions are sorted
    within a partition, and only the open block is held. Blocks are numbered from 0.
    """
    rows = speech_spans(cues)
    text = F.coalesce(F.col("text"), F.lit(""))
    out = ~F.col("has_text")
    if skip_music:
        out = out | text.rlike(MUSIC)
    if skip_songs:
        out = out | sung(text)
    order = ["pos"] if "pos" in cues.columns else ["a"]
    rows = rows.select(*keys, *order, "a", F.col("speech_end").alias("b"), text.alias("text"), out.alias("skip"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order, "a")
    schema = StructType([*(rows.schema[k] for k in keys), StructField("block", LongType()), StructField("a", LongType()), StructField("b", LongType()), StructField("reference", StringType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, number, start, reach, parts = None, 0, 0, None, []
        for batch in batches:
            done = []

            def flush() -> None:
                nonlocal number, parts
                if parts:
                    done.append((*key, number, start, max(e for e, _ in parts), "".join(t for _, t in parts)))
                    number += 1
                parts = []

            for k, a, b, t, skip in zip(batch[keys].itertuples(index=False, name=None), batch["a"], batch["b"], batch["text"], batch["skip"]):
                if k != key:
                    flush()
                    key, number, reach = k, 0, None
                if skip:
                    flush()
                    reach = None
                    continue
                if reach is not None and a - reach > PART_MS:
                    flush()
                if not parts:
                    start = a
                parts.append((b, t))
                reach = b if reach is None else max(reach, b)
                if reach - start >= seconds * 1000:
                    flush()
                    reach = None
            yield pd.DataFrame(done, columns=schema.names)
        if parts:
            yield pd.DataFrame([(*key, number, start, max(e for e, _ in parts), "".join(t for _, t in parts))], columns=schema.names)

    return rows.mapInPandas(fold, schema)


def joined_text(rows: DataFrame, keys: list[str], order: list[str], text: str, separator: str = "") -> DataFrame:
    """(keys, ``text``): the texts of a key in order, as one."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(*keys).agg(parts.alias("__p")).select(*keys, F.array_join(F.transform("__p", lambda p: p[text]), separator).alias(text))


def block_texts(block: DataFrame, segments: DataFrame, keys: list[str], config: str = "config") -> DataFrame:
    """(config, keys, block, reference, hypothesis): each block with the text of the segments whose middle it holds, in
    order; blocks without any have an empty text."""
    hits = points_in(segments, block.select(*keys, "block", "a", "b"), keys, F.col("a") + F.col("b"))
    said = joined_text(hits, [config, *keys, "block"], ["a", "pos"], "text").withColumnRenamed("text", "hypothesis")
    every = segments.select(config, *keys).distinct().join(block.select(*keys, "block", "reference"), keys)
    return every.join(said, [config, *keys, "block"], "left").withColumn("hypothesis", F.coalesce("hypothesis", F.lit("")))


def exclusive(spans: DataFrame, keys: list[str], config: str = "config", minimum: int = 1000) -> DataFrame:
    """(config_a, config_b, keys, side, a, b): for every pair of configurations of a recording, what only one of them covers.

    Spans are merged once for each configuration; there are as many pairs as configurations allow, never pairs of rows.
    """
    merged = cut(merge(spans, [config, *keys]))
    there = merged.select(config, *keys).distinct()
    x = there.select(F.col(config).alias("config_a"), *keys)
    y = there.select(F.col(config).alias("config_b"), *keys)
    pairs = x.join(y, keys).where("config_a < config_b")
    left = pairs.join(merged.withColumnRenamed(config, "config_a"), ["config_a", *keys])
    right = pairs.join(merged.withColumnRenamed(config, "config_b"), ["config_b", *keys])
    on = ["config_a", "config_b", *keys]
    left, right = left.select(*on, "a", "b"), right.select(*on, "a", "b")
    return subtract(left, right, on, minimum).withColumn("side", F.lit("a")).unionByName(subtract(right, left, on, minimum).withColumn("side", F.lit("b")))


def survey(cues: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, counts ...): the caption survey of a recording."""
    rows = speech_spans(cues).withColumn("back", F.coalesce(F.col("a") < F.lag("a").over(Window.partitionBy(*keys).orderBy("pos")), F.lit(False)))
    text = F.coalesce(F.col("text"), F.lit(""))

    def count(c: Column) -> Column:
        return F.count_if(c)

    shown = F.col("has_text")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("cues"),
        count(shown).alias("text_cues"),
        count(~shown).alias("empty_cues"),
        F.sum(F.when(shown, F.col("speech_ms")).otherwise(0)).alias("text_ms"),
        F.sum(F.when(shown, F.col("screen_ms")).otherwise(0)).alias("screen_ms"),
        count(shown & (F.col("held_ms") > 500)).alias("held_cues"),
        F.sum(F.greatest(F.lit(0), F.coalesce(F.size("ruby"), F.lit(0)))).cast("bigint").alias("ruby_runs"),
        F.sum(F.coalesce("drcs", F.lit(0))).cast("bigint").alias("drcs"),
        F.sum(F.length(F.regexp_replace(text, "[^０-９]", ""))).cast("bigint").alias("wide_digits"),
        F.sum(F.length(F.regexp_replace(text, "[^ ]", ""))).cast("bigint").alias("spaces"),
        count(F.col("back")).alias("out_of_order"),
        count(F.col("b") <= F.col("a")).alias("inverted"),
    )


def survey_labels(cues: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, label, n): how often each leading label was read, in brackets or before a colon."""
    line = F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n|\r\n?"))
    rows = cues.select(*keys, line.alias("l")).withColumn("l", trimmed(F.col("l")))
    bracket, colon = F.regexp_extract("l", BRACKET_LABEL, 1), F.regexp_extract("l", COLON_LABEL, 1)
    rows = rows.withColumn("kind", F.when(bracket != "", "bracket").when(colon != "", "colon")).withColumn("label", F.when(bracket != "", bracket).otherwise(colon))
    return rows.where("kind is not null").groupBy(*keys, "kind", "label").agg(F.count("*").alias("n"))


def suspects(cues: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ch, n): characters that are neither plain Japanese nor ASCII."""
    rows = cues.select(*keys, F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "")).alias("ch"))
    return rows.where(F.col("ch").rlike("[^\\x00-\\x7f぀-ヿ一-鿿　-〿＀-￯]")).groupBy(*keys, "ch").agg(F.count("*").alias("n"))


def top(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(f"__n <= {n}").drop("__n")
