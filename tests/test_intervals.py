from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cuelight.operators import intervals as iv
from cuelight.operators import periods, speech
from tests.conftest import rows

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
spans = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(-3, 20)).map(lambda x: (x[0], x[1] * 200_000, x[1] * 200_000 + x[2] * 500_000)), max_size=25)


def frame(spark, values):
    return spark.createDataFrame(values, "k int, a bigint, b bigint")


def union(values):
    out = {}
    for k, a, b in sorted(v for v in values if None not in v[1:] and v[2] > v[1]):
        own = out.setdefault(k, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    return out


@few
@given(values=spans)
def test_periods_and_gaps_equal_a_sweep_across_hours(spark, values):
    want = []
    for k, own in union(values).items():
        want += [(k, "period", a, b) for a, b in own] + [(k, "gap", x[1], y[0]) for x, y in zip(own, own[1:])]
    assert rows(periods.periods_and_gaps(frame(spark, values), ["k"], "a", "b")) == sorted(want, key=repr)


def test_periods_take_nulls_repeats_and_nothing(spark):
    values = [(None, 0, 5), (None, 5, 9), (1, None, 3), (1, 4, None), (1, 4, 4), (1, 1, 2), (1, 1, 2)]
    assert rows(periods.periods_and_gaps(frame(spark, values), ["k"], "a", "b")) == [(1, "period", 1, 2), (None, "period", 0, 9)]
    assert rows(periods.periods_and_gaps(frame(spark, []), ["k"], "a", "b")) == []


def test_periods_do_not_mind_other_columns(spark):
    df = spark.createDataFrame([(1, 0, 5, "x", 9)], "k int, a bigint, b bigint, kind string, __hour int")
    assert rows(periods.periods_and_gaps(df, ["k"], "a", "b")) == [(1, "period", 0, 5)]


@few
@given(left=spans, right=spans)
def test_subtract_equals_points(spark, left, right):
    def covered(values, k):
        return {t for kk, a, b in values if kk == k for t in range(a // 100_000, b // 100_000)}

    got = iv.subtract(iv.merge(frame(spark, left), ["k"]), iv.merge(frame(spark, right), ["k"]), ["k"], 1)
    points = {k: set() for k in range(3)}
    for k, a, b in rows(got):
        points[k] |= set(range(a // 100_000, b // 100_000))
    for k in range(3):
        assert points[k] == covered(left, k) - covered(right, k)


def test_subtract_keeps_pieces_of_the_minimum(spark):
    left, right = frame(spark, [(1, 0, 3000)]), frame(spark, [(1, 1000, 2001)])
    assert rows(iv.subtract(left, right, ["k"], 1000)) == [(1, 0, 1000)]


def test_holes_are_longer_than_the_minimum(spark):
    merged = frame(spark, [(1, 20, 30), (1, 50, 60)])
    total = spark.createDataFrame([(1, 90)], "k int, total bigint")
    assert rows(iv.holes(merged, ["k"], 19, total)) == [(1, 0, 20), (1, 30, 50), (1, 60, 90)]
    assert rows(iv.holes(merged, ["k"], 20)) == []


def test_split_long_keeps_exact_multiples(spark):
    got = iv.split_long(frame(spark, [(1, 0, 60), (2, 0, 61), (3, 0, 1)]), 30)
    assert rows(got, "k", "a", "b") == [(1, 0, 30), (1, 30, 60), (2, 0, 30), (2, 30, 60), (2, 60, 61), (3, 0, 1)]


def test_padding_shares_narrow_gaps(spark):
    runs = spark.createDataFrame([(1, 5, 10, 100), (1, 17, 20, 100), (1, 40, 99, 100)], "k int, a bigint, b bigint, total bigint")
    assert rows(iv.padded(runs, ["k"], 6, "total"), "a", "b") == [(0, 13), (14, 26), (34, 100)]


@few
@given(points=st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400)), max_size=20), own=spans)
def test_points_in_equals_a_nested_loop(spark, points, own):
    merged = [(k, a, b) for k, xs in union(own).items() for a, b in xs]
    p = [(0, x * 50_000, x * 50_000 + y * 1000 + 1) for x, y in points]
    got = iv.points_in(frame(spark, p), frame(spark, merged), ["k"], iv.F.col("a") + iv.F.col("b"))
    want = sorted(((k, a, b, x, y) for k, a, b in p for kk, x, y in merged if k == kk and 2 * x <= a + b < 2 * y), key=repr)
    assert rows(got, "k", "a", "b", "span_a", "span_b") == want


def test_overlap_is_strict_on_both_sides(spark):
    left, right = frame(spark, [(1, 0, 10), (1, 10, 20), (1, 25, 200_000), (2, 0, 10)]), frame(spark, [(1, 10, 25), (1, 190_000, 195_000)])
    assert rows(iv.overlapping(left, right, ["k"])) == [(1, 10, 20), (1, 25, 200_000)]
    assert rows(iv.overlapping(left, right, ["k"], "left_anti")) == [(1, 0, 10), (2, 0, 10)]


def test_samples_are_clamped_merged_and_counted(spark):
    merged, counts = iv.to_samples(frame(spark, [(1, -5, 10), (1, 10, 20), (1, 30, 30), (1, 90, 120), (1, None, 4)]), ["k"], 100 * 16)
    assert rows(merged) == [(1, 0, 320), (1, 1440, 1600)]
    assert rows(counts) == [(1, 5, 2, 2, 1)]


def hysteresis(track, upper, lower, silence):
    out, begin, low = [], None, None
    for i, p in enumerate(track):
        if p >= upper:
            begin, low = (i if begin is None else begin), None
        elif begin is not None and p < lower:
            low = i if low is None else low
            if i - low >= silence:
                out.append((begin, low))
                begin = low = None
    return out + ([(begin, len(track))] if begin is not None else [])


@few
@given(track=st.lists(st.integers(0, 9), max_size=60), silence=st.integers(1, 4))
def test_runs_equal_the_state_machine(spark, track, silence):
    f = spark.createDataFrame([(1, i, p) for i, p in enumerate(track)], "k int, idx bigint, p int")
    got = speech.runs(f, ["k"], "p", 7, 4, silence, step=1)
    assert rows(got, "a", "b") == sorted(hysteresis(track, 7, 4, silence), key=repr)


def smooth(flags, pad, least, silence):
    out, begin, quiet = [], None, 0
    for i, on in enumerate(flags):
        if on:
            begin, quiet = (max(0, i - pad) if begin is None else begin), 0
        elif begin is not None:
            quiet += 1
            if quiet >= silence:
                end = min(len(flags), i + pad)
                out += [(begin, end)] if end - begin >= least else []
                begin = None
    return out + ([(begin, len(flags))] if begin is not None else [])


@few
@given(flags=st.lists(st.booleans(), max_size=40), silence=st.integers(1, 4))
def test_smoothed_flags_equal_the_state_machine(spark, flags, silence):
    f = spark.createDataFrame([(1, i, x) for i, x in enumerate(flags)], "k int, idx bigint, on boolean")
    assert rows(speech.smoothed_flags(f, ["k"], "on", 2, 5, silence), "a", "b") == sorted(smooth(flags, 2, 5, silence), key=repr)


def test_thresholds_must_not_cross(spark):
    import pytest

    with pytest.raises(ValueError):
        speech.runs(frame(spark, []).withColumnRenamed("a", "idx"), ["k"], "b", 1, 2, 1)


def test_raster_lists_each_frame_once(spark):
    got = rows(iv.raster(frame(spark, [(1, 0, 16), (1, 10, 40), (1, 90, 60), (1, -20, 3), (2, None, 4)]), ["k"]))
    assert got == [(1, 0), (1, 1), (1, 2)]
