"""Queries that do the whole job where DuckDB cannot say it, against plain Python over the same rows."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict

import pytest

from cuelight import plans
from cuelight.functions import text as tx
from tests.conftest import rows

SEGMENT = "seg_id bigint, config string, stem string, reel bigint, pos bigint, id bigint, start_s double, end_s double, text string, words array<struct<word:string,start_s:double,end_s:double,probability:double>>"
CUE = "cue_id bigint, stem string, reel bigint, pos bigint, start_s double, end_s double, text string, ruby array<string>, drcs int, cleared boolean"
TRANSCRIPT = "config string, stem string, reel bigint, lang string, duration double"

CUES = [
    (1, "a", 0, 0, 0.0, 10.0, "こんにちは、世界", None, 0, False),
    (2, "a", 0, 1, 10.0, 20.0, "Hello there", None, 0, False),
    (3, "a", 0, 2, 20.0, 30.0, "（すすり泣き）ぐみ：ｱｲ です。", None, 0, False),
    (4, "b", 0, 0, 0.0, 10.0, "Привет, мир", None, 0, False),
]
SEGMENTS = [
    (1, "x", "a", 0, 0, 0, 0.0, 4.0, "こんにちわ", None),
    (2, "x", "a", 0, 1, 1, 4.0, 8.0, "世界", None),
    (3, "x", "a", 0, 2, 2, 10.0, 12.0, "Hello ", None),
    (4, "x", "a", 0, 3, 3, 12.0, 14.0, "thére", None),
    (5, "x", "a", 0, 4, 4, 20.0, 24.0, "アイです", [("アイ", 20.0, 22.0, 0.9), ("です", 22.0, 24.0, 0.9)]),
    (6, "x", "b", 0, 0, 0, 0.0, 3.0, "Привет мир", None),
    (7, "y", "b", 0, 0, 0, None, None, "ja? nein", None),
    (8, "y", "b", 0, 1, 1, 2.0, 1.0, "  ", None),
]
TRANSCRIPTS = [("x", "a", 0, "JA", 40.0), ("x", "b", 0, None, 40.0), ("y", "b", 0, "de", 40.0)]


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """A folder with captions and segments of several scripts."""
    d = str(tmp_path_factory.mktemp("mixed"))
    for name, values, schema in (("cues", CUES, CUE), ("segments", SEGMENTS, SEGMENT), ("transcripts", TRANSCRIPTS, TRANSCRIPT)):
        spark.createDataFrame(values, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def bare(text):
    return re.sub(f"[{tx.SPACE}]+", "", text)


def pairs():
    """(config, cue_id, stem) -> reference and hypothesis without white space, of all scripts."""
    said = defaultdict(str)
    for c, stem, a, b in ((x, x[1], x[4], x[5]) for x in CUES):
        end = min(b, a + min(20, max(2, 1.2 * len(bare(c[6])))))
        for s in SEGMENTS:
            x = s[6] or 0.0
            y = x if s[7] is None else s[7]
            if s[2] == stem and a <= (x + y) / 2 < end:
                said[s[1], c[0], stem] += s[8]
    text = {c[0]: bare(c[6]) for c in CUES}
    return {k: (text[k[1]], bare(h)) for k, h in said.items()}


def test_edits_of_every_script(spark, mixed):
    want = sorted((c, cue, len(r), len(h), distance(r, h) if r else 0) for (c, cue, _), (r, h) in pairs().items())
    assert [w[:2] for w in want] == [("x", 1), ("x", 2), ("x", 3), ("x", 4), ("y", 4)]
    assert rows(plans.QUERIES["edit_distance"](spark, mixed)) == want


def test_totals_of_every_script(spark, mixed):
    sums = defaultdict(lambda: [0, 0, 0, 0])
    for (c, _, stem), (r, h) in pairs().items():
        for k in ((c, stem, 0), (c, None, 1)):
            for i, x in enumerate((1, len(r), len(h), distance(r, h))):
                sums[k][i] += x
    got = {(r.config, r.stem, r.total): r for r in plans.QUERIES["cer_totals"](spark, mixed).collect()}
    assert set(got) == set(sums)
    for k, (n, ref, hyp, edits) in sums.items():
        assert (got[k].blocks, got[k].ref_chars, got[k].hyp_chars, got[k].edits) == (n, ref, hyp, edits)
        assert got[k].cer == edits / ref and got[k].length_ratio == hyp / ref


def test_levels_of_every_script(spark, mixed):
    got = {r.cue_id: (r.asis, r.markup, r.plain) for r in plans.QUERIES["cue_levels"](spark, mixed).collect()}
    assert got == {
        1: ("こんにちは、世界", "こんにちは、世界", "こんにちは世界"),
        2: ("Hellothere", "Hellothere", "Hellothere"),
        3: ("（すすり泣き）ぐみ：ｱｲです。", got[3][1], re.sub(f"[{tx.PUNCTUATION}]", "", unicodedata.normalize("NFKC", got[3][1]))),
        4: ("Привет,мир", "Привет,мир", "Приветмир"),
    }
    assert got[3][2].endswith("アイです") and "すすり泣き" not in got[3][1]


def test_imagined_words_of_every_script(spark, mixed):
    want = []
    for s in SEGMENTS:
        if s[9] or not s[8].strip():
            continue
        lang = {(t[0], t[1]): t[3] for t in TRANSCRIPTS}[s[1], s[2]]
        units = [c for c in s[8] if c.strip()] if lang == "JA" else re.findall(r"\s*\S+", s[8])
        a, total, done = s[6] or 0.0, sum(map(len, units)), 0
        span = max(0.0, (a if s[7] is None else s[7]) - a)
        for n, u in enumerate(units):
            x, done = done, done + len(u)
            want.append((s[0], n, u, math.floor((a + span * x / total) * 1000 + 0.5), math.floor((a + span * done / total) * 1000 + 0.5)))
    got = rows(plans.QUERIES["word_timing"](spark, mixed))
    assert {s[0] for s in got} == {1, 2, 3, 4, 6, 7}
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=repr)]
    assert all(abs(g[i] - w[i]) <= 1 for g, w in zip(got, sorted(want, key=repr)) for i in (3, 4))


def test_reels_are_clamped_to_their_own_length(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([("x", "a", 0, "ja", 500.0), ("y", "a", 0, "ja", 600.0), ("x", "b", 0, "ja", 10.0), ("x", "c", 0, "ja", None)], TRANSCRIPT).write.parquet(f"{d}/transcripts.parquet")
    spans = [("a", -1.0, 2.0), ("a", 300.0, 400.0), ("a", 590.0, 700.0), ("a", 601.0, 602.0), ("b", 5.0, 8.0), ("b", 7.0, 20.0), ("c", 1000.0, 1001.0), ("c", None, 3.0)]
    spark.createDataFrame([(s, 0, "v", a, b) for s, a, b in spans], "stem string, reel bigint, backend string, start_s double, end_s double").write.parquet(f"{d}/regions.parquet")
    assert [(s, a / 16000, b / 16000) for s, a, b in rows(plans.QUERIES["reel_clip"](spark, d), "stem", "a", "b")] == [("a", 0.0, 2.0), ("a", 300.0, 400.0), ("a", 590.0, 600.0), ("b", 5.0, 10.0), ("c", 1000.0, 1001.0)]
    assert rows(plans.QUERIES["reel_clip_counts"](spark, d), "stem", "received", "dropped", "clamped", "merged") == [("a", 4, 1, 3, 0), ("b", 2, 0, 1, 1), ("c", 2, 1, 0, 0)]


def test_loop_statistics_count_all_rules_of_both_detectors(spark, tmp_path):
    d = str(tmp_path)
    texts = [("x", "うん。うん。うん。うん。"), ("x", "あ" * 12), ("x", "いやいやいやいや"), ("x", "よーし、よーし、よーし、よーし"), ("x", "やったーーーーーーーー"), ("x", "今日はいい天気。"), ("y", "（ｱｱ） "), ("y", None)]
    spark.createDataFrame([(i, c, "a", 0, i, i, float(i), i + 1.0, t, None) for i, (c, t) in enumerate(texts)], SEGMENT).write.parquet(f"{d}/segments.parquet")
    df = plans.QUERIES["loop_drop_stats"](spark, d)
    got = rows(df.where("total = 1"), "config", "detector", "before", "after", "dropped", "chars", "dropped_chars")
    # at the plain level the texts have 8, 12, 8, 12, 11, 7 characters; only the production detector keeps the short units
    assert got == [("x", "production", 6, 3, 3, 58, 35), ("x", "score", 6, 1, 5, 58, 51), ("y", "production", 2, 2, 0, 0, 0), ("y", "score", 2, 2, 0, 0, 0)]
    assert rows(df.where("total = 0"), "config", "detector", "before", "after", "dropped", "chars", "dropped_chars") == got
    assert {(r.config, r.detector): r.share for r in df.where("total = 1").collect()} == {("x", "production"): 35 / 58, ("x", "score"): 51 / 58, ("y", "production"): 0.0, ("y", "score"): 0.0}


def test_differences_of_every_pair_and_side(spark, tmp_path):
    d = str(tmp_path)
    spans = [("x", 0, 10, "one"), ("x", 200, 290, "far"), ("y", 5, 30, "two"), ("z", 0, 5, "three"), ("z", 5, 9, "four")]
    spark.createDataFrame([(i, c, "a", 0, i, i, float(a), float(b), t, None) for i, (c, a, b, t) in enumerate(spans)], SEGMENT).write.parquet(f"{d}/segments.parquet")
    got = rows(plans.QUERIES["difference_texts"](spark, d), "config_a", "config_b", "side", "x", "y", "text")
    assert got == sorted(
        [
            ("x", "y", "a", 0, 5000, "one"), ("x", "y", "a", 200_000, 290_000, "far"), ("x", "y", "b", 10_000, 30_000, "two"),
            ("x", "z", "a", 9000, 10_000, "one"), ("x", "z", "a", 200_000, 290_000, "far"),
            ("y", "z", "a", 9000, 30_000, "two"), ("y", "z", "b", 0, 5000, "three"),
        ], key=repr,
    )
    assert rows(plans.QUERIES["widest_differences"](spark, d), "config_a", "config_b", "side", "a", "b") == [g[:5] for g in got]
