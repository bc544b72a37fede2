"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.llm import bpe, lookalikes, mixing, pieces, residue, sentences, subjects, turns
from cuelight.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "segments"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece = 1").select("seg_id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(table(spark, sf_dir, "segments"), table(spark, sf_dir, "size_limits"))


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of segments and cues under one id."""
    s, c = table(spark, sf_dir, "segments"), table(spark, sf_dir, "cues")
    s = s.select(F.lit("segments").alias("tab"), "stem", "reel", F.col("seg_id").alias("id"), "text")
    return s.unionByName(c.select(F.lit("cues").alias("tab"), "stem", "reel", F.col("cue_id").alias("id"), "text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.same_look(_captions(spark, sf_dir), ["tab", "stem", "reel"], "id").select("tab", "id_a", "id_b")


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.canonical(_captions(spark, sf_dir), ["tab", "id"]).select("tab", "id", "canonical")


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of classes of one look that are written in several ways, with their class and spelling."""
    rows = lookalikes.look_classes(_captions(spark, sf_dir), ["tab", "stem", "reel"], "id")
    varied = rows.where("spelling_id <> class_id").select("tab", "stem", "reel", "class_id").distinct()
    return rows.join(varied, ["tab", "stem", "reel", "class_id"], "left_semi").select("tab", "id", "class_id", "spelling_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.boundaries(table(spark, sf_dir, "segments"))


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "segments"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.turn_starts(table(spark, sf_dir, "cues"), table(spark, sf_dir, "cue_stats"))


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.turns(table(spark, sf_dir, "cues"), table(spark, sf_dir, "cue_stats"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "area_labels"), table(spark, sf_dir, "subject_areas"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_canonical": p3_canonical, "p3_classes": p3_classes, "p4_found": p4_found, "p4_sentences": p4_sentences, "p6_found": p6_found, "p6_turns": p6_turns, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found}

SQL = {
    "p2_found": """
select distinct seg_id from segments join size_limits using (config)
where length(text) > max_chars or cast(round(end_s * 1000) as bigint) - cast(round(start_s * 1000) as bigint) > max_ms"""
}
