from __future__ import annotations

import json

import pytest

from cuelight.functions import options
from cuelight.sources import captions, media, outputs, transcripts
from tests.conftest import rows

VTT = """﻿WEBVTT

00:01:42.536 --> 00:01:46.874
<v b24caption0><c>%0C</c></v>
<v b24caption1><c>%^H</c>ruby<c>%^J</c>body text<c>%+{...%+}</c></v>

01:02,5 --> 01:03,25 line:1
plain <i>two</i>
lines

100:00:00.000 --> 100:00:01.000
<v b24caption0><c>%0C</c></v>
"""


def test_captions(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.vtt").write_text(VTT, encoding="utf-8")
    (tmp_path / "b" / "x.VTT").write_text("00:01.0 --> 00:02.0\nno\n", encoding="utf-8")
    (tmp_path / "b" / "y.vtt").write_bytes(b"00:01.0 --> 00:02.0\n\xff!\n\n\nloose line\n")
    df = captions.read_captions(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    got = {(r.stem, r.pos): r for r in df.collect()}
    assert set(got) == {("x", 0), ("x", 1), ("x", 2), ("y", 0)}
    r = got["x", 0]
    assert (r.start_s, r.end_s, r.text, r.ruby, r.drcs, r.cleared) == (102.536, 106.874, "body text", ["ruby"], 1, True)
    assert got["x", 1].start_s == 62.5 and got["x", 1].text == "plain two\nlines" and got["x", 2].text == "" and got["x", 2].cleared
    assert got["y", 0].text == "�!"
    assert rows(captions.duplicate_stems(spark, [str(tmp_path)])) == [("x", 2)]


def test_transcripts(spark, tmp_path):
    a = {"language": "ja", "duration": 9.5, "segments": [{"id": 3, "start": 2.0, "end": 3.0, "text": "b"}, {"start": None, "text": None}, {"id": 0, "start": 2.0, "text": "c", "words": [{"word": " w ", "start": 2.0, "end": 2.5}]}]}
    (tmp_path / "a.json").write_text(json.dumps(a))
    (tmp_path / "b.json").write_text("{}")
    df = transcripts.read_transcripts(spark, str(tmp_path), "c1")
    assert rows(df, "stem", "pos", "start_s", "end_s", "text") == [("a", 0, 0.0, 0.0, ""), ("a", 1, 2.0, 3.0, "b"), ("a", 2, 2.0, 2.0, "c")]
    twins = spark.createDataFrame([("a", 1.0)], "stem string, duration double")
    third = transcripts.read_third_party(spark, str(tmp_path), twins).collect()
    assert len(third) == 1 and third[0].duration == 9.5
    assert [s.id for s in third[0].segments] == [3, 2, 3] and third[0].segments[2].words[0].word == "w"


def test_regions(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"a": [[0.5, 1.0], [2.0, 3.0]], "b": []}))
    df = transcripts.read_regions(spark, str(p))
    assert rows(df) == [("a", 0.5, 1.0), ("a", 2.0, 3.0)]
    with pytest.raises(Exception, match="no regions of 'z'"):
        transcripts.read_regions(spark, str(p), ["z"]).collect()
    transcripts.write_regions(df, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"a": [[0.5, 1.0], [2.0, 3.0]]}


def test_media(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("b.MP4", "a.wav", "in/c.mkv", "note.pdf"):
        (tmp_path / n).write_text("")
    (tmp_path / "list.m3u").write_text("# x\n\n/elsewhere/z.ts\n")
    got = media.collect([str(tmp_path / "*.*"), str(tmp_path / "in"), str(tmp_path / "a.wav")])
    assert [g.rsplit("/", 1)[1] for g in got] == ["a.wav", "b.MP4", "z.ts", "a.wav"]
    assert [g.rsplit("/", 1)[1] for g in media.collect([str(tmp_path)], recursive=True)] == ["a.wav", "b.MP4", "c.mkv"]
    df = media.listed(spark, [str(tmp_path / "*.*")], check=True)
    assert rows(df, "stem") == [("a",), ("b",)]
    done = spark.createDataFrame([("a",)], "stem string")
    assert rows(media.pending(df, done, ["stem"]), "stem") == [("b",)] and media.pending(df, done, ["stem"], redo=True).count() == 2


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([("f", 2, 2, 59_996, 61_000, "x\ty"), ("f", 1, 1, 0, 1500, " a\nb ")], "stem string, seg_id bigint, pos bigint, a bigint, b bigint, text string")
    doc = {k: outputs.documents(df, ["stem"], k).first().document for k in ("srt", "vtt", "txt", "tsv", "lrc")}
    assert doc["srt"] == "1\n00:00:00,000 --> 00:00:01,500\na\nb\n\n2\n00:00:59,996 --> 00:01:01,000\nx\ty\n\n"
    assert doc["vtt"].startswith("WEBVTT\n\n1\n00:00:00.000 -->") and doc["txt"] == "a b\nx y\n"
    assert doc["tsv"] == "start\tend\ttext\n0.000\t1.500\ta b\n59.996\t61.000\tx y\n" and doc["lrc"] == "[00:00.00]a b\n[00:60.00]x y\n"
    assert outputs.formats(["text", "all", "nope", "srt"]) == ["txt", "srt", "vtt", "tsv", "lrc", "json"]
    paths = outputs.write(df.withColumn("id", df.seg_id), ["stem"], ["srt", "json"], str(tmp_path))
    assert spark.read.text(paths[0], wholetext=True).first().value == doc["srt"]
    with pytest.raises(ValueError):
        outputs.part("doc", *[df.a] * 4)


def test_options():
    d = {"max_line_width": 1000, "max_line_count": 1, "sentence": False, "standard": False, "standard_asia": False, "audio": None, "pair": [0, 3.0], "gap": 3.0}
    out = options.resolve(d, {"max_line_width": 20}, {"standard-asia": "yes", "profiles": {"p": {"gap": "1.5"}}, "active_profile": "p"})
    assert (out["max_line_width"], out["max_line_count"], out["sentence"], out["gap"]) == (20, 2, True, 1.5)
    assert options.resolve(d, {"gap": 9.0}, {"gap": 1, "override": True})["gap"] == 1.0
    assert options.threshold("ten") == 0.75 and options.threshold("precomputed") == 0.45
    for bad in ({"nope": 1}, {"audio": "x"}, {"pair": [1]}, {"sentence": "maybe"}, {"gap": "x"}, {"active_profile": "q"}):
        with pytest.raises(options.OptionError):
            options.resolve(d, {}, bad, blocked=("audio",))


def test_last_known_runs_over_blocks(spark):
    from pyspark.sql import functions as F

    from cuelight.operators.ordered import last_known

    df = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, None), (1, 1, 3, None), (1, 3, 4, "b"), (1, 3, 5, None), (2, 0, 1, None)], "k int, block int, n int, v string")
    got = {(r.k, r.n): (r.now, r.before) for r in last_known(last_known(df, ["k"], "block", ["n"], F.col("v"), "now"), ["k"], "block", ["n"], F.col("v"), "before", current=False).collect()}
    assert got == {(1, 1): ("a", None), (1, 2): ("a", "a"), (1, 3): ("a", "a"), (1, 4): ("b", "a"), (1, 5): ("b", "b"), (2, 1): (None, None)}
