"""Names, options, whole files, labels and range joins by golden cases; queries without SQL by their own rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cuelight import plans
from cuelight.functions import options
from cuelight.functions import text as tx
from cuelight.operators import detectors as dt
from cuelight.operators import intervals as iv
from cuelight.sources import outputs
from tests.conftest import rows


def test_names_and_clocks(spark):
    df = spark.createDataFrame([(0, "kaze mori/02.ts"), (1, "--"), (2, "朝の番組①"), (3, "x" * 27)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(tx.slug(F.col("t"))).collect()] == ["kaze-mori-02.ts", "model", "朝の番組①", "x" * 27]
    assert [r[0] for r in df.select(tx.short(F.col("t"), 26)).collect()][3] == "x" * 25 + "…"
    r = spark.range(1).select(tx.wall_clock(F.lit(90_061_999)).alias("w"), tx.described(F.lit("♪")).alias("d"), tx.escaped(F.lit("é漢a")).alias("e"), tx.escaped(F.lit("ok")).alias("o")).first()
    assert (r.w, r.d, r.e, r.o) == ("01:01:01", "U+266A EIGHTH NOTE", "\\xe9\\u6f22a", "ok")


def test_option_types():
    like = {"beam": 5, "ratio": 0.5, "flag": False, "names": ["a"], "pair": [1, 2], "mode": "x", "audio": None}
    got = options.resolve(like, {}, {"beam": 3.0, "ratio": 1, "flag": "on", "names": "b", "pair": ["3", 4]}, choices={"mode": ("x", "y")})
    assert got["beam"] == 3 and isinstance(got["beam"], int) and got["ratio"] == 1.0 and got["flag"] is True and got["names"] == ["b"] and got["pair"] == [3, 4]
    for wrong in ({"beam": 3.7}, {"beam": True}, {"beam": [1]}, {"pair": [1]}, {"mode": "z"}, {"audio": "f.wav"}, {"other": 1}):
        with pytest.raises(options.OptionError):
            options.resolve(like, {}, wrong, choices={"mode": ("x", "y")})


def test_configuration_is_found(tmp_path):
    (tmp_path / "b.yaml").write_text("beam: 3")
    assert options.discover(None, str(tmp_path), ("a.yaml", "b.yaml")).endswith("b.yaml") and options.discover(None, str(tmp_path), ("c",)) is None
    with pytest.raises(options.OptionError):
        options.discover(str(tmp_path / "x.yaml"), str(tmp_path), ())


def test_json_files(spark, tmp_path):
    schema = "config string, stem string, reel bigint, pos bigint, seg_id bigint, id bigint, start_s double, end_s double, text string, no_speech_prob double, words array<struct<word:string,start_s:double,end_s:double,probability:double>>"
    values = [("c", "s", 0, 1, 2, 7, 1.23456, None, None, None, []), ("c", "s", 0, 0, 9, 3, 0.5, 1.0, "あ", 0.123456, [("あ", 0.5, 1.0, 0.98765)])]
    df = spark.createDataFrame(values, schema)
    known = spark.createDataFrame([("c", "s", 0, "ja", 9.87654)], "config string, stem string, reel bigint, language string, duration double")
    got = json.loads(outputs.json_documents(df, known, ["config", "stem", "reel"]).first().document)
    assert got == {
        "language": "ja",
        "duration": 9.877,
        "segments": [
            {"id": 3, "start": 0.5, "end": 1.0, "text": "あ", "no_speech_prob": 0.1235, "words": [{"word": "あ", "start": 0.5, "end": 1.0, "probability": 0.9877}]},
            {"id": 7, "start": 1.235, "end": 1.235, "text": ""},
        ],
    }
    assert json.loads(outputs.json_documents(df, known.limit(0), ["config", "stem", "reel"]).first().document)["language"] == ""
    assert outputs.json_documents(df.limit(0), known, ["config", "stem", "reel"]).collect() == []
    assert outputs.write(df, ["config", "stem", "reel"], ["json"], str(tmp_path)) and json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/json", wholetext=True).collect()))["segments"][0]["id"] == 3


def test_output_files(spark):
    got = outputs.output_files(spark.createDataFrame([("x/a.ja",)], "base string"), ["text", "all", "txt", "none"])
    assert [r.file for r in got.orderBy("n").collect()] == [f"x/a.ja{s}" for s in (".txt", ".srt", ".vtt", ".tsv", ".lrc", ".json")]


def test_labels_of_speech(spark):
    df = spark.createDataFrame([(1, "male"), (2, "music"), (3, "speech"), (4, None), (5, "female")], "i int, label string")
    assert rows(dt.labelled(df, "label"), "i") == [(1,), (3,), (5,)]


def test_range_joins_of_odd_rows(spark):
    left = spark.createDataFrame([("k", 0, 10, 1), ("k", 0, 10, 1), ("k", 5, 5, 2), ("k", None, 4, 3), ("k", 900_000, 900_001, 4), (None, 0, 10, 5)], "k string, a bigint, b bigint, n int")
    spans = spark.createDataFrame([("k", 4, 10**15), ("k", None, 3), (None, 9, 12), ("k", 2, 2)], "k string, a bigint, b bigint")
    assert rows(iv.overlapping(left, spans, ["k"]), "n") == [(1,), (1,), (2,), (4,), (5,)]
    assert rows(iv.overlapping(left, spans, ["k"], "left_anti"), "n") == [(3,)]
    points = iv.points_in(left.where("a is not null"), spans, ["k"], F.col("a") * 2)
    assert rows(points, "n", "span_a") == [(2, 4), (4, 4)]
    assert rows(iv.overlapping(left, spans.limit(0), ["k"], "left_anti"), "n") == [(1,), (1,), (2,), (3,), (4,), (5,)]


def test_filter_statistics_count_what_the_filters_drop(spark, data):
    got = {(r.config, r.filter): r for r in plans.QUERIES["filter_stats"](spark, data).collect()}
    hits = [r for r in plans.QUERIES["loop_filter"](spark, data).collect()]
    assert sum(r.dropped for (_, f), r in got.items() if f == "loop") == len(hits)
    assert sum(r.chars for (_, f), r in got.items() if f == "loop") == sum(r.folded_chars for r in hits)
    assert all(len(r.examples or []) == min(3, r.dropped) for r in got.values())
    kept = plans.QUERIES["filtered_segments"](spark, data).count()
    assert kept + len(hits) == sum(r.segments for (_, f), r in got.items() if f == "loop")


def test_periods_of_very_many_rows_of_one_key(spark):
    """One key with more intervals an hour than a chunk holds, many hours, long spans over hours and a null key."""
    from cuelight.operators.periods import CHUNK, HOUR_MS, periods_and_gaps

    n = 5 * CHUNK
    df = spark.range(n).selectExpr("'k' k", f"id * 2000 % {6 * HOUR_MS} * 2 a", f"id * 2000 % {6 * HOUR_MS} * 2 + 1000 b")
    df = df.unionByName(spark.createDataFrame([("k", 1, 3 * HOUR_MS), (None, 5, 6), ("k", None, 3), ("k", 9, 9)], "k string, a bigint, b bigint"))
    want, reach = [], None
    for r in sorted((r.a, r.b) for r in df.where("k = 'k' and a < b").collect()):
        if reach is None or r[0] > reach:
            want.append([r[0], r[1]])
        reach = want[-1][1] = max(want[-1][1], r[1])
    got = periods_and_gaps(df, ["k"], "a", "b")
    assert rows(got.where("kind = 'period' and k = 'k'"), "start_ms", "end_ms") == sorted(map(tuple, want), key=repr)
    gaps = [(x[1], y[0]) for x, y in zip(want, want[1:])]
    assert rows(got.where("kind = 'gap'"), "start_ms", "end_ms") == sorted(gaps, key=repr)
    assert rows(got.where("k is null"), "kind", "start_ms", "end_ms") == [("period", 5, 6)]


def test_clusters_must_name_their_checkpoint_folder():
    from cuelight import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
