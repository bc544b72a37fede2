from __future__ import annotations

from cuelight.functions.registry import register
from cuelight.operators.measurements import levels, stage_faults
from tests.conftest import rows


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("select nfkc('ｱ①') n, plain_text('ｱ、 b') p, lcs_length('abcd', 'xbyd') l, widest_repeat('abababab').count w, most_repeats('aaab') m, lcs_length(null, 'a') z").first()
    assert (r.n, r.p, r.l, r.w, r.m, r.z) == ("ア1", "アb", 2, 4, 3, None)
    got = spark.sql("select pos, start_s, text from caption_cues('00:01.0 --> 00:02.0\\nhi\\n\\n00:03.5 --> 00:04.0\\n')")
    assert rows(got) == [(0, 1.0, "hi"), (1, 3.5, "")]


def test_measurements(spark):
    logs = [(1, 0, False, "Duration: 00:01:40.50, x\nmean_volume: -20.5 dB\nmax_volume: -3.0 dB"), (1, 1, False, "Duration: 00:01:38.00 max_volume: -4.1 dB"), (1, 2, True, "Duration: 00:00:50.00 max_volume: -inf dB"), (2, 0, False, "")]
    df = levels(spark.createDataFrame(logs, "file int, stage int, may_stretch boolean, log string"))
    assert rows(df, "file", "stage", "peak_db", "mean_db", "seconds") == [(1, 0, -3.0, -20.5, 100.5), (1, 1, -4.1, float("-inf"), 98.0), (1, 2, float("-inf"), float("-inf"), 50.0), (2, 0, float("-inf"), float("-inf"), None)]
    assert rows(stage_faults(df, ["file"]), "file", "stage", "fault") == [(1, 0, None), (1, 1, "drift"), (1, 2, "silent"), (2, 0, "silent")]
