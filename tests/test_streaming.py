from __future__ import annotations

from cuelight.streaming.duplicates import kept_stream
from cuelight.streaming.sessions import speech_sessions
from tests.conftest import rows


def drain(spark, df, name, mode, where):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(where)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_duplicates_keep_their_state_between_batches(spark, tmp_path):
    schema = "stem string, pos bigint, text string"
    src = tmp_path / "in"
    spark.createDataFrame([("f", 0, "A"), ("f", 1, "A"), ("g", 0, "A")], schema).coalesce(1).write.mode("append").json(str(src))
    spark.createDataFrame([("f", 2, "A"), ("f", 3, "B"), ("f", 4, None)], schema).coalesce(1).write.mode("append").json(str(src))
    df = kept_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)), ["stem"])
    got = rows(drain(spark, df, "kept", "append", tmp_path / "cp"))
    assert got == [("f", 0, "A"), ("f", 1, "A"), ("f", 3, "B"), ("f", 4, None), ("g", 0, "A")]


def test_sessions_end_with_silence(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    frames = [("f", at(0), True), ("f", at(2), True), ("f", at(3), False), ("f", at(9), True), ("f", at(59), True)]
    spark.createDataFrame(frames, "stem string, at string, voiced boolean").coalesce(1).write.json(str(tmp_path / "in"))
    df = speech_sessions(spark.readStream.schema("stem string, at timestamp, voiced boolean").json(str(tmp_path / "in")), ["stem"])
    got = drain(spark, df, "sessions", "append", tmp_path / "cp").selectExpr("stem", "unix_timestamp(end) - unix_timestamp(start) s", "frames")
    assert rows(got) == [("f", 3, 1), ("f", 5, 2)]
