from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuelight.functions import text as tx
from cuelight.operators import detectors as dt
from cuelight.operators import distance, resegment, scoring
from tests.conftest import rows


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "seg_id bigint, text string")


def test_levels(spark):
    df = texts(spark, ["ぐみ：ｱｲ　（すすり泣き）です。\n12345678901: x", "（" + "あ" * 40 + "）（" + "い" * 41 + "）", "♬やった〜➡", None])
    got = df.select(*(tx.normalised(F.coalesce("text", F.lit("")), n).alias(n) for n in tx.LEVELS)).collect()
    assert got[0].asis == "ぐみ：ｱｲ（すすり泣き）です。12345678901:x"
    assert got[0].markup == "ｱｲです。12345678901:x" and got[0].plain == "アイです12345678901x"
    assert got[1].plain == "(" + "い" * 41 + ")" and got[2].markup == "やった〜" and got[2].plain == "やった" and got[3].plain == ""
    with pytest.raises(ValueError):
        tx.normalised(F.lit("x"), "loud")


def test_sung(spark):
    df = texts(spark, ["♩ら", "〜", "「らら」 「るる」", "彼は「はい」と", "", "（名）"])
    assert [r[0] for r in df.orderBy("seg_id").select(tx.sung(F.col("text"))).collect()] == [True, True, True, False, False, False]


def test_budget_and_timestamps(spark):
    df = texts(spark, ["", "あ", "あいう", "あ" * 50])
    assert [r[0] for r in df.orderBy("seg_id").select(tx.budget_ms(F.col("text"))).collect()] == [2000, 2000, 3600, 20000]
    r = spark.range(1).select(tx.timestamp(F.lit(3_723_004)).alias("s"), tx.timestamp(F.lit(90_000_000), ".").alias("v"), tx.clock(F.lit(59_960)).alias("c")).first()
    assert (r.s, r.v, r.c) == ("01:02:03,004", "25:00:00.000", "0:01:00.0")


LOOPS = ["うっうっうっうっうっうっうっうっ", "チューチューチューチューチューチュー", "やったーーーーーーーー", "あ、あ、あ、あ、あ、あ、あ、あ、あ、あ、あ、あ", "よーし、よーし、よーし、よーし", "あ" * 8]
SPEECH = ["きゃあああああ", "そそそそんなわけ", "ええええ!?", "うわああああ", "いやいやいや", "それはそれは大変でしたね", "ハァ…ハァ…", "今日はいい天気", "", None, "abcdef" * 3 + "xyz" * 4, "あ" * 7]


def test_loop_filter(spark):
    got = dt.loops(texts(spark, LOOPS + SPEECH)).orderBy("seg_id").collect()
    assert [r.loop is not None for r in got] == [True] * len(LOOPS) + [False] * len(SPEECH)


def test_unit_scan_skips_what_it_found():
    assert dt.repeats("aaaabababababab", dt.SCAN, True) == (3, 12)
    assert dt.repeats("abcdef" * 3 + "xyz" * 4, dt.SCAN, True) == (3, 18)
    assert dt.repeats("abcdef" * 3 + "xyz" * 4, dt.SCORE_SCAN, False) == (4, 12)


def test_detectors_differ_where_they_are_defined_to(spark):
    got = dt.score_loops(texts(spark, ["いやいやいやいや", "abcdef" * 3 + "xyz" * 4, "はい"])).orderBy("seg_id").collect()
    assert [r.loop for r in got] == [True, True, False]
    assert dt.loops(texts(spark, ["いやいやいやいや"])).first().loop is None


def test_stock_phrases(spark):
    p = dt.PHRASES[0]
    got = dt.phrases(texts(spark, [p, f"「{p}。」", p + "ねえ", p + "ねえあ", "また来週", None])).orderBy("seg_id").collect()
    assert [(r.phrase, r.whole) for r in got] == [(p, True), (p, True), (p, True), (p, False), (None, False), (None, False)]


def test_anomaly_bounds(spark):
    df = spark.createDataFrame([(1, 0, 30_000, 30), (2, 0, 30_001, 31), (3, 0, 20_000, 20), (4, 0, 20_000, 19), (5, 0, 1000, 20), (6, 0, 1000, 15), (7, 0, 1334, 20), (8, 5, 0, 0)], "seg_id int, a bigint, b bigint, n int")
    got = {r.seg_id: (r.over30, r.thin, r.dense) for r in dt.anomalies(df, F.col("n")).collect()}
    assert got == {1: (False, False, False), 2: (True, False, False), 3: (False, False, False), 4: (False, True, False), 5: (False, False, True), 6: (False, False, False), 7: (False, False, False), 8: (False, False, False)}


def kept(spark, values):
    df = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(values)], "k int, pos bigint, seg_id bigint, text string")
    return [r.kept for r in dt.repeated_runs(df, ["k"], ["pos"]).orderBy("seg_id").collect()]


def test_repeated_runs(spark):
    assert kept(spark, ["A", "A", "A", "A"]) == [True, True, False, False]
    assert kept(spark, ["A", "B", "A"]) == [True] * 3
    assert kept(spark, ["A", " ", "A", None, "A"]) == [True] * 5
    assert kept(spark, ["x", "ぬね" * 6, "ぬ" * 11]) == [True, True, False]
    assert kept(spark, ["x", "ぬ" * 10, "ぬ" * 10]) == [True, True, True]


def test_selection_and_first_delivery(spark):
    df = spark.createDataFrame([("kaze_a", 2), ("kaze_a", 1), ("yuki_kaze", 1), ("b", 0)], "stem string, at int")
    assert rows(dt.selected(df, "stem", ["kaze", "zz"], ["yuki"])) == [("kaze_a", 1), ("kaze_a", 2)]
    assert rows(dt.first_delivery(df, ["stem"], ["at"])) == [("b", 0), ("kaze_a", 1), ("yuki_kaze", 1)]


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common_length_equals_the_table():
    r = random.Random(7)
    for _ in range(300):
        a, b = ("".join(r.choice("あいうab") for _ in range(r.randrange(30))) for _ in range(2))
        assert distance.common_length(a, b) == table_lcs(a, b)
    x, y = "".join(r.choice("abcdefgh") for _ in range(500)), "".join(r.choice("ijklmnop") for _ in range(500))
    assert distance.common_length(x + y, y + x) == 500


def test_long_distances_equal_the_built_in_one(spark):
    r = random.Random(8)
    pairs = [tuple("".join(r.choice("あいうab𠮷") for _ in range(r.randrange(40))) for _ in range(2)) for _ in range(300)]
    df = spark.createDataFrame([*pairs, ("", ""), ("", "x"), (None, "x")], "a string, b string")
    got = df.select(distance.edit_length("a", "b").alias("x"), F.levenshtein("a", "b").alias("y")).collect()
    assert [g.x for g in got] == [g.y for g in got]


def test_pair_scores_and_totals(spark):
    df = spark.createDataFrame([("c", "f", "abc", "abd"), ("c", "g", "", "xyz"), ("c", "g", None, None), ("c", "g", "ab", None)], "config string, stem string, r string, h string")
    s = distance.pair_scores(df, F.col("r"), F.col("h"))
    assert rows(s, "ref_chars", "hyp_chars", "edits", "matches", "empty_ref") == [(0, 0, 0, 0, 1), (0, 3, 0, 0, 1), (2, 0, 2, 0, 0), (3, 3, 1, 2, 0)]
    t = {(r.stem, r.total): r for r in distance.rolled_up(s, ["config"], ["stem"]).collect()}
    assert t[None, 1].cer == 3 / 5 and t[None, 1].coverage == 2 / 5 and t["f", 0].precision == 2 / 3 and t["g", 0].edits == 2


def test_diagnosis(spark):
    df = spark.createDataFrame([(0.96, 0.97), (0.5, 0.9), (0.9, 0.5), (0.5, 0.6)], "c double, p double")
    assert [r[0] for r in df.select(distance.diagnosis(F.col("c"), F.col("p"))).collect()] == ["close", "missed", "invention", "both"]


def test_blocks(spark):
    c = [(0, 0, 3000, "あいう"), (1, 4000, 6000, "えお"), (2, 9000, 12000, "か"), (3, 12500, 13000, "♪♫"), (4, 13500, 14000, "き"), (5, 14200, 15000, ""), (6, 15000, 80000, "く" * 40), (7, 36000, 37000, "け")]
    df = spark.createDataFrame([(1, *x) for x in c], "k int, pos bigint, a bigint, b bigint, text string")
    got = rows(scoring.blocks(df, ["k"], 20))
    assert got == [(1, 0, 0, 6000, "あいうえお"), (1, 1, 9000, 11000, "か"), (1, 2, 13500, 14000, "き"), (1, 3, 15000, 35000, "く" * 40), (1, 4, 36000, 37000, "け")]
    assert rows(scoring.blocks(df.limit(0), ["k"])) == []


W = "array<struct<word:string,start_s:double,end_s:double,probability:double>>"


def worded(spark, values):
    return spark.createDataFrame([(1, i, i, i * 10, *v) for i, v in enumerate(values)], f"k int, seg_id bigint, pos bigint, id bigint, start_s double, end_s double, text string, words {W}")


def word(w, a, b):
    return (w, a, b, 0.5)


def test_sanitise_rebuilds_after_the_first_repair(spark):
    whole = [word(" a", 1.0, 1.5), word(" b", 1.6, 2.0)]
    paused = [word("x", 3.0, 3.5), word("y", 10.0, 10.5)]
    df = worded(spark, [(1.0, 2.0, " a b ", whole), (3.0, 10.5, "xy", paused), (1.0, 2.0, " a b ", whole), (0.0, 40.0, "long", None), (5.0, 6.0, "short", None)])
    got = resegment.sanitised(df, ["k"]).orderBy("id").collect()
    assert [(r.id, r.start_s, r.end_s, r.text) for r in got] == [(0, 1.0, 2.0, " a b "), (1, 3.0, 3.5, "x"), (2, 10.0, 10.5, "y"), (3, 1.0, 2.0, "a b"), (4, 0.0, 30.0, "long"), (5, 5.0, 6.0, "short")]


def test_sanitise_leaves_sound_files_alone(spark):
    df = worded(spark, [(1.0, 2.0, " a ", [word(" a", 1.0, 2.0)]), (None, None, None, None), (3.0, 4.0, "t", [(None, 1.0, 2.0, None)])])
    got = resegment.sanitised(df, ["k"]).orderBy("seg_id").collect()
    assert [(r.id, r.start_s, r.end_s, r.text) for r in got] == [(0, 1.0, 2.0, " a "), (10, None, None, None), (20, 3.0, 4.0, "t")]


def test_length_is_bounded_whatever_the_gap(spark):
    words = [word(str(i), float(i * 5), i * 5 + 4.5 - (i == 3) * 1.0) for i in range(12)]
    got = resegment.sanitised(worded(spark, [(0.0, 60.0, "t", words)]), ["k"], max_gap="0").collect()
    assert max(r.end_s - r.start_s for r in got) <= 30 and "".join(r.text for r in sorted(got, key=lambda r: r.id)) == "".join(map(str, range(12)))
    one = resegment.sanitised(worded(spark, [(0.0, 45.0, "t", [word("one", 0.0, 45.0)])]), ["k"]).collect()
    assert [(r.start_s, r.end_s) for r in one] == [(0.0, 45.0)]


def test_format(spark):
    df = worded(spark, [(0.0, 4.0, "あいうえ、おかき。くけこ", None), (4.0, 5.0, None, None), (5.0, 9.0, "one two three four", None)])
    got = resegment.formatted(df, ["k"], 4, 2, True, language=None).orderBy("id").collect()
    assert [r.text for r in got] == ["あいうえ、\nおかき。", "くけこ", None, "one\ntwo", "three\nfour"]
    assert [r.id for r in got] == list(range(5)) and got[0].start_s == 0.0 and got[1].end_s == 4.0
    same = resegment.formatted(df, ["k"])
    assert same.count() == 3 and same.where("seg_id = 1").first().id == 10
