"""Queries of the interval algebra and the speech runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.operators import intervals as iv
from cuelight.operators import scoring, speech
from cuelight.plans.base import CUE, FRM, REEL, REG, SEG, SPOKEN, TAKE, cues, durations, frames, merged, regions, segments
from cuelight.session import table

#: Samples of a reel that regions are clamped to, and the pieces' length, of the queries.
SAMPLES, PIECE_MS = 240_000 * 16, 8_000
VOICE = ["backend", *REEL]


def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    return iv.merge(regions(spark, d), VOICE)


def interval_gaps(spark: SparkSession, d: str) -> DataFrame:
    return scoring.caption_gaps(cues(spark, d), REEL, 5_000, durations(spark, d))


def interval_subtract(spark: SparkSession, d: str) -> DataFrame:
    r = regions(spark, d)
    ends = r.agg(F.min("backend").alias("lo"), F.max("backend").alias("hi"))  # one row
    r = r.join(F.broadcast(ends), (F.col("backend") == F.col("lo")) | (F.col("backend") == F.col("hi")))
    left, right = (iv.merge(r.where(F.col("backend") == F.col(x)), REEL) for x in ("lo", "hi"))
    return iv.subtract(left, right, REEL, 1000)


def backend_differences(spark: SparkSession, d: str) -> DataFrame:
    """What only one of two detectors covers, of every pair of detectors and both sides; ``interval_subtract`` is one of them."""
    only = scoring.exclusive(regions(spark, d).where("b > a"), REEL, "backend")
    return only.select("config_a", "config_b", "side", *REEL, "a", "b")


def interval_clip(spark: SparkSession, d: str) -> DataFrame:
    return iv.to_samples(regions(spark, d), VOICE, SAMPLES)[0]


def interval_clip_counts(spark: SparkSession, d: str) -> DataFrame:
    return iv.to_samples(regions(spark, d), VOICE, SAMPLES)[1]


def _own_samples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = regions(spark, d).join(durations(spark, d), REEL, "left")
    return iv.to_samples(r, VOICE, F.col("total") * 16)


def reel_clip(spark: SparkSession, d: str) -> DataFrame:
    """The regions of every reel, clamped to its own length where one is known, and merged."""
    return _own_samples(spark, d)[0]


def reel_clip_counts(spark: SparkSession, d: str) -> DataFrame:
    return _own_samples(spark, d)[1]


def interval_max_split(spark: SparkSession, d: str) -> DataFrame:
    return iv.split_long(iv.merge(regions(spark, d), VOICE), PIECE_MS)


def vad_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return speech.runs(frames(spark, d), ["stem"], "p", 75, 60, 512)


def vad_padded(spark: SparkSession, d: str) -> DataFrame:
    r = speech.runs(frames(spark, d), ["stem"], "p", 75, 60, 512).where("b - a > 512")
    return iv.padded(r, ["stem"], 480, "total").select("stem", "a", "b")


def vad_flags(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("on", F.col("p") >= 75)
    return speech.smoothed_flags(f, ["stem"], "on", 2, 6, 3)


def vad_share(spark: SparkSession, d: str) -> DataFrame:
    m = iv.merge(regions(spark, d), VOICE).groupBy(*VOICE).agg(F.sum(F.col("b") - F.col("a")).alias("speech_ms"))
    m = m.join(durations(spark, d), REEL)
    return m.select(*VOICE, "speech_ms", F.when(F.col("total") > 0, F.col("speech_ms") / F.col("total")).otherwise(0.0).alias("share"))


def raster_frames(spark: SparkSession, d: str) -> DataFrame:
    return iv.raster(regions(spark, d), VOICE).groupBy(*VOICE).agg(F.count("*").alias("frames"))


def midpoint_gap_join(spark: SparkSession, d: str) -> DataFrame:
    gaps = scoring.caption_gaps(cues(spark, d), REEL, 5_000)
    hits = scoring.gap_hits(segments(spark, d), gaps, REEL)
    return hits.groupBy(*TAKE).agg(F.count("*").alias("segments"), F.sum(F.greatest(F.lit(0), F.col("b") - F.col("a"))).cast("bigint").alias("ms"), F.sum(F.length("text")).alias("chars"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return scoring.speech_spans(cues(spark, d)).where("has_text and speech_end > a").select("cue_id", *REEL, "a", F.col("speech_end").alias("b"))


def midpoint_block_join(spark: SparkSession, d: str) -> DataFrame:
    hits = iv.points_in(segments(spark, d), _spans(spark, d), REEL, F.col("a") + F.col("b"))
    return scoring.joined_text(hits, ["config", "cue_id"], ["a", "pos"], "text")


def overlap_semi(spark: SparkSession, d: str) -> DataFrame:
    return iv.overlapping(segments(spark, d).where("b > a"), _spans(spark, d), REEL).select("seg_id")


def unassigned_anti(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    hit = iv.points_in(s, _spans(spark, d), REEL, F.col("a") + F.col("b")).select("seg_id").distinct()
    return s.join(hit, "seg_id", "left_anti").groupBy("config").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"))


def config_pairs(spark: SparkSession, d: str) -> DataFrame:
    only = scoring.exclusive(segments(spark, d).where("b > a"), REEL)
    return only.groupBy("config_a", "config_b", "side").agg(F.count("*").alias("pieces"), F.sum(F.col("b") - F.col("a")).alias("ms"))


def topk_widest(spark: SparkSession, d: str) -> DataFrame:
    only = scoring.exclusive(segments(spark, d).where("b > a"), REEL).where("config_a = 'rawpass_x' and config_b = 'sil6_plain' and side = 'a'")
    return scoring.top(only, REEL, [(F.col("b") - F.col("a")).desc(), F.col("a")], 3).select(*REEL, "a", "b")


def texts_in_differences(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).where("b > a")
    only = topk_widest(spark, d).withColumnsRenamed({"a": "x", "b": "y"})
    hits = s.where("config = 'rawpass_x'").join(only, REEL).where("a < y and b > x and text <> ''")
    return scoring.joined_text(hits, [*REEL, "x", "y"], ["a", "pos"], "text", " / ")


def widest_differences(spark: SparkSession, d: str) -> DataFrame:
    """The widest spans that one configuration of a pair covers alone, of every pair and both sides."""
    only = scoring.exclusive(segments(spark, d).where("b > a"), REEL)
    on = ["config_a", "config_b", "side", *REEL]
    return scoring.top(only, on, [(F.col("b") - F.col("a")).desc(), F.col("a")], 3).select(*on, "a", "b")


def difference_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the configuration of the side has in those spans."""
    only = widest_differences(spark, d).withColumnsRenamed({"a": "x", "b": "y"})
    only = only.withColumn("config", F.when(F.col("side") == "a", F.col("config_a")).otherwise(F.col("config_b")))
    s = iv.bucketed(segments(spark, d).where("b > a and text <> ''"), "a", "b")
    # a pair is taken once, in the first bucket that both have
    first = F.floor(F.greatest("a", "x") / iv.BUCKET_MS) == F.col("__bucket")
    hits = s.join(iv.bucketed(only, "x", "y"), [*TAKE, "__bucket"]).where("a < y and b > x").where(first)
    return scoring.joined_text(hits, ["config_a", "config_b", "side", *REEL, "x", "y"], ["a", "pos"], "text", " / ")


def label_seconds(spark: SparkSession, d: str) -> DataFrame:
    return regions(spark, d).where("b > a").groupBy("backend").agg(F.count("*").alias("regions"), F.sum(F.col("b") - F.col("a")).alias("ms"))


def stem_intersect(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcripts").select("config", "stem").distinct()
    every = t.select("config").distinct().count()
    return t.groupBy("stem").agg(F.count("*").alias("configs")).where(F.col("configs") == every).select("stem")


QUERIES = {
    f.__name__: f
    for f in (
        interval_merge, interval_gaps, interval_subtract, backend_differences, interval_clip, interval_clip_counts, reel_clip, reel_clip_counts, interval_max_split, vad_hysteresis, vad_padded, vad_flags, vad_share,
        raster_frames, midpoint_gap_join, midpoint_block_join, overlap_semi, unassigned_anti, config_pairs, topk_widest, texts_in_differences, widest_differences, difference_texts, label_seconds, stem_intersect,
    )
}

_GAPS = f"""{CUE}, {SPOKEN}, sp as (select stem, reel, a, speech_end b from spoken where has_text), {merged("sp", "stem, reel")},
gp as (select stem, reel, coalesce(greatest(lag(b) over (partition by stem, reel order by a), 0), 0) a, a b from mrg)"""
_OWN = f"""{REG}, d as (select stem, reel, cast(round(max(duration) * 1000) as bigint) total from transcripts where duration is not null group by all),
c as (select backend, stem, reel, a * 16 ra, b * 16 rb, total * 16 n, greatest(a * 16, 0) a, least(b * 16, total * 16) b from reg left join d using (stem, reel)), {merged("c", "backend, stem, reel", where="a < b and ra is not null and rb is not null")}"""
_RUNS = f"""{FRM}, g as (select *, sum(case when p >= 75 then 1 else 0 end) over (partition by stem order by idx) g, count(*) over (partition by stem) n from frm),
h as (select stem, g, min(idx) x, min(case when p < 60 then idx end) f, max(case when p < 60 then idx end) l, max(n) * 256 total from g where g > 0 group by stem, g),
k as (select *, coalesce((l - f) * 256 >= 512, false) broke from h),
o as (select *, coalesce(lag(broke) over (partition by stem order by g), true) opens from k),
r as (select *, sum(case when opens then 1 else 0 end) over (partition by stem order by g) run from o),
runs as (select stem, min(x) * 256 a, coalesce(max(case when broke then f * 256 end), max(total)) b, max(total) total from r group by stem, run)"""
_SPANS = f"{SEG}, {CUE}, {SPOKEN}, sp as (select cue_id, stem, reel, a, speech_end b from spoken where has_text and speech_end > a)"
_ONLY = f"""{SEG}, {merged("seg", "config, stem, reel")},
th as (select distinct config, stem, reel from mrg),
pr as (select x.config config_a, y.config config_b, stem, reel from th x join th y using (stem, reel) where x.config < y.config),
ev as (select config_a, config_b, stem, reel, s.side, unnest([m.a, m.b]) t, unnest([1, -1]) * (case when s.side = 'a' then 1 else 0 end) dx, unnest([1, -1]) * (case when s.side = 'a' then 0 else 1 end) dy
 from pr join mrg m using (stem, reel) cross join (values ('a'), ('b')) s(side) where m.config = config_a
 union all select config_a, config_b, stem, reel, s.side, unnest([m.a, m.b]), unnest([1, -1]) * (case when s.side = 'b' then 1 else 0 end), unnest([1, -1]) * (case when s.side = 'b' then 0 else 1 end)
 from pr join mrg m using (stem, reel) cross join (values ('a'), ('b')) s(side) where m.config = config_b),
st as (select config_a, config_b, stem, reel, side, t, sum(dx) dx, sum(dy) dy from ev group by all),
sw as (select config_a, config_b, stem, reel, side, t a, lead(t) over w b, sum(dx) over (w rows unbounded preceding) x, sum(dy) over (w rows unbounded preceding) y
 from st window w as (partition by config_a, config_b, stem, reel, side order by t)),
excl as (select * from sw where x > 0 and y = 0 and b - a >= 1000)"""
_APART = _ONLY.replace(SEG, "seg as (select backend config, stem, reel, cast(round(start_s * 1000) as bigint) a, cast(round(end_s * 1000) as bigint) b from regions)")
_TOP = f"""{_ONLY}, tp as (select *, row_number() over (partition by stem, reel order by b - a desc, a) n from excl
 where config_a = 'rawpass_x' and config_b = 'sil6_plain' and side = 'a'), w as (select stem, reel, a, b from tp where n <= 3)"""
_WIDEST = f"""{_ONLY}, tp as (select *, row_number() over (partition by config_a, config_b, side, stem, reel order by b - a desc, a) n from excl),
w as (select config_a, config_b, side, stem, reel, a, b from tp where n <= 3)"""

SQL = {
    "interval_merge": f"with {REG}, {merged('reg', 'backend, stem, reel')} select * from mrg",
    "interval_gaps": f"""with {_GAPS}, d as (select stem, reel, cast(round(max(duration) * 1000) as bigint) total from transcripts where duration is not null group by all),
e as (select stem, reel, greatest(max(b), 0) a from mrg group by all)
select * from gp where b - a > 5000 union all select stem, reel, a, total from e join d using (stem, reel) where total - a > 5000""",
    "interval_subtract": f"""with {REG}, {merged("reg", "backend, stem, reel")}, nm as (select min(backend) x, max(backend) y from reg),
ev as (select stem, reel, unnest([a, b]) t, unnest([1, -1]) dx, 0 dy from mrg, nm where backend = x union all select stem, reel, unnest([a, b]), 0, unnest([1, -1]) from mrg, nm where backend = y),
st as (select stem, reel, t, sum(dx) dx, sum(dy) dy from ev group by all),
sw as (select stem, reel, t a, lead(t) over w b, sum(dx) over (w rows unbounded preceding) x, sum(dy) over (w rows unbounded preceding) y from st window w as (partition by stem, reel order by t))
select stem, reel, a, b from sw where x > 0 and y = 0 and b - a >= 1000""",
    "backend_differences": f"with {_APART} select config_a, config_b, side, stem, reel, a, b from excl",
    "interval_clip": f"""with {REG}, c as (select backend, stem, reel, greatest(a * 16, 0) a, least(b * 16, {SAMPLES}) b from reg), {merged("c", "backend, stem, reel")} select * from mrg""",
    "interval_clip_counts": f"""with {REG}, c as (select backend, stem, reel, a * 16 ra, b * 16 rb, greatest(a * 16, 0) a, least(b * 16, {SAMPLES}) b from reg), {merged("c", "backend, stem, reel")},
n as (select backend, stem, reel, count(*) received, count(*) filter (where not coalesce(b > a, false)) dropped, count(*) filter (where ra < 0 or rb > {SAMPLES}) clamped, count(*) filter (where b > a) kept from c group by all),
k as (select backend, stem, reel, count(*) l from mrg group by all)
select backend, stem, reel, received, dropped, clamped, kept - coalesce(l, 0) merged from n left join k using (backend, stem, reel)""",
    "reel_clip": f"with {_OWN} select * from mrg",
    "reel_clip_counts": f"""with {_OWN}, f as (select *, coalesce(b > a and ra is not null and rb is not null, false) fits from c),
n as (select backend, stem, reel, count(*) received, count(*) filter (where not fits) dropped, count(*) filter (where ra < 0 or rb > n) clamped, count(*) filter (where fits) kept from f group by all),
k as (select backend, stem, reel, count(*) l from mrg group by all)
select backend, stem, reel, received, dropped, clamped, kept - coalesce(l, 0) merged from n left join k using (backend, stem, reel)""",
    "interval_max_split": f"""with {REG}, {merged("reg", "backend, stem, reel")}, p as (select *, unnest(range(0, cast(greatest(1, ceil((b - a) / {PIECE_MS}.0)) as bigint))) piece from mrg)
select backend, stem, reel, a + piece * {PIECE_MS} a, least(b, a + (piece + 1) * {PIECE_MS}) b, cast(piece as int) piece from p""",
    "vad_hysteresis": f"with {_RUNS} select * from runs",
    "vad_padded": f"""with {_RUNS}, f as (select *, a - lag(b) over (partition by stem order by a) pg, lead(a) over (partition by stem order by a) - b ng from runs where b - a > 512)
select stem, greatest(0, a - case when pg < 960 then pg // 2 else 480 end) a, case when ng < 960 then b + ng // 2 else least(total, b + 480) end b from f""",
    "vad_flags": f"""with {FRM}, o as (select stem, idx, coalesce(idx - lag(idx) over (partition by stem order by idx) > 3, true) fresh from frm where p >= 75),
i as (select *, sum(case when fresh then 1 else 0 end) over (partition by stem order by idx) run from o), n as (select stem, count(*) n from frm group by 1),
e as (select stem, greatest(0, min(idx) - 2) a, max(idx) y, any_value(n) n from i join n using (stem) group by stem, run),
z as (select stem, a, y + 3 >= n op, case when y + 3 >= n then n else least(n, y + 5) end b from e) select stem, a, b from z where op or b - a >= 6""",
    "vad_share": f"""with {REG}, {merged("reg", "backend, stem, reel")}, d as (select stem, reel, cast(round(max(duration) * 1000) as bigint) total from transcripts where duration is not null group by all),
s as (select backend, stem, reel, cast(sum(b - a) as bigint) speech_ms from mrg group by all)
select backend, stem, reel, speech_ms, case when total > 0 then speech_ms / total else 0 end share from s join d using (stem, reel)""",
    "raster_frames": f"""with {REG}, f as (select distinct backend, stem, reel, unnest(range(greatest(0, a * 16 // 256), b * 16 // 256 + 1)) frame from reg) select backend, stem, reel, count(*) frames from f group by all""",
    "midpoint_gap_join": f"""with {SEG}, {_GAPS}, g as (select * from gp where b - a > 5000)
select config, s.stem, s.reel, count(*) segments, cast(sum(greatest(0, s.b - s.a)) as bigint) ms, cast(sum(length(text)) as bigint) chars
from seg s join g on s.stem = g.stem and s.reel = g.reel and s.a + s.b >= 2 * g.a and s.a + s.b < 2 * g.b group by all""",
    "midpoint_block_join": f"""with {_SPANS} select config, cue_id, string_agg(text, '' order by s.a, s.pos, text) text
from seg s join sp p on s.stem = p.stem and s.reel = p.reel and s.a + s.b >= 2 * p.a and s.a + s.b < 2 * p.b group by all""",
    "overlap_semi": f"""with {_SPANS} select seg_id from seg s where b > a and exists (select 1 from sp p where s.stem = p.stem and s.reel = p.reel and s.a < p.b and s.b > p.a)""",
    "unassigned_anti": f"""with {_SPANS} select config, count(*) segments, cast(sum(length(text)) as bigint) chars from seg s
where not exists (select 1 from sp p where s.stem = p.stem and s.reel = p.reel and s.a + s.b >= 2 * p.a and s.a + s.b < 2 * p.b) group by config""",
    "config_pairs": f"with {_ONLY} select config_a, config_b, side, count(*) pieces, cast(sum(b - a) as bigint) ms from excl group by all",
    "topk_widest": f"with {_TOP} select * from w",
    "texts_in_differences": f"""with {_TOP} select w.stem, w.reel, w.a x, w.b y, string_agg(text, ' / ' order by s.a, s.pos, text) text from w join seg s
on s.stem = w.stem and s.reel = w.reel and s.config = 'rawpass_x' and s.b > s.a and s.a < w.b and s.b > w.a and text <> '' group by all""",
    "widest_differences": f"with {_WIDEST} select * from w",
    "difference_texts": f"""with {_WIDEST} select config_a, config_b, side, w.stem, w.reel, w.a x, w.b y, string_agg(text, ' / ' order by s.a, s.pos, text) text from w join seg s
on s.stem = w.stem and s.reel = w.reel and s.config = case when side = 'a' then config_a else config_b end and s.b > s.a and s.a < w.b and s.b > w.a and text <> '' group by all""",
    "label_seconds": f"with {REG} select backend, count(*) regions, cast(sum(b - a) as bigint) ms from reg where b > a group by 1",
    "stem_intersect": "select stem from transcripts group by stem having count(distinct config) = (select count(distinct config) from transcripts)",
}
