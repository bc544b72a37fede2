"""Queries of the score report, filter statistics, labelled regions and whole output files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import text as tx
from cuelight.operators import detectors as dt
from cuelight.operators import intervals as iv
from cuelight.operators import scoring
from cuelight.plans import text
from cuelight.plans.base import CUE, REEL, SEG, SPOKEN, TAKE, WS, cues, durations, merged, segments, worded
from cuelight.session import table
from cuelight.sources import outputs
from cuelight.sources.transcripts import FILE

#: Milliseconds of the shortest stretch without captions that is scored, and of the shortest that the survey lists.
GAP_MS, HOLE_MS = 5_000, 20_000
#: Labels of the events that stand for speech in ``labelled_regions``.
SPEECH = ("click", "view")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return scoring.caption_gaps(cues(spark, d), REEL, GAP_MS, durations(spark, d))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    hits = scoring.gap_hits(segments(spark, d), _gaps(spark, d), REEL)
    return hits.withColumn("said", tx.normalised(F.col("text"), "markup")).withColumn("ms", F.greatest(F.lit(0), F.col("b") - F.col("a")))


def gap_scores(spark: SparkSession, d: str) -> DataFrame:
    """What every configuration says where no caption speaks, for every file, those without captions or hits too."""
    gaps = _gaps(spark, d).groupBy(*REEL).agg(F.count("*").alias("gaps"), F.sum(F.col("b") - F.col("a")).alias("gap_ms"))
    hits = _hits(spark, d).groupBy(*TAKE).agg(F.count("*").alias("segments"), F.sum("ms").cast("bigint").alias("ms"), F.sum(F.length("said")).alias("chars"))
    captioned = table(spark, d, "cues").select(*REEL).distinct().withColumn("captioned", F.lit(True))
    rows = segments(spark, d).select(*TAKE).distinct().join(captioned, REEL, "left").join(gaps, REEL, "left").join(hits, TAKE, "left")
    rows = rows.fillna(0, ["gaps", "gap_ms", "segments", "ms", "chars"]).withColumn("captioned", F.coalesce("captioned", F.lit(False)))
    rate = F.when(F.col("gap_ms") > 0, F.col("segments") * 60000 / F.col("gap_ms")).otherwise(0.0)
    return rows.select(*TAKE, "captioned", "gaps", "gap_ms", "segments", "ms", "chars", rate.alias("per_minute"))


def gap_examples(spark: SparkSession, d: str) -> DataFrame:
    """The three widest such segments with a text of every configuration and file."""
    rows = _hits(spark, d).where("said <> ''")
    return scoring.top(rows, TAKE, [F.col("ms").desc(), F.col("a"), F.col("pos")], 3).select(*TAKE, "seg_id", "ms")


def top_holes(spark: SparkSession, d: str) -> DataFrame:
    """The four longest stretches without captions of every file."""
    holes = scoring.caption_gaps(cues(spark, d), REEL, HOLE_MS, durations(spark, d))
    return scoring.top(holes, REEL, [(F.col("b") - F.col("a")).desc(), F.col("a")], 4).select(*REEL, "a", "b")


def top_speakers(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent labels of every file."""
    rows = scoring.survey_labels(cues(spark, d), REEL).groupBy(*REEL, "label").agg(F.sum("n").alias("n"))
    return scoring.top(rows, REEL, [F.col("n").desc(), F.col("label")], 5).select(*REEL, "label", "n")


def suspect_names(spark: SparkSession, d: str) -> DataFrame:
    """The suspect characters of the survey by their names."""
    return text.suspect_chars(spark, d).withColumn("name", tx.described("ch")).drop("ch")


def filter_stats(spark: SparkSession, d: str) -> DataFrame:
    """What the production filters of loops and stock phrases drop, of every configuration, with the first three examples."""
    rows = dt.phrases(dt.loops(segments(spark, d))).select(*TAKE, "pos", "a", "text", "loop", "folded_chars", "phrase", "whole")
    kinds = F.array(
        F.struct(F.lit("loop").alias("filter"), F.col("loop").isNotNull().alias("hit"), F.col("loop").isNotNull().alias("dropped"), F.col("loop").alias("why")),
        F.struct(F.lit("phrase").alias("filter"), F.col("phrase").isNotNull().alias("hit"), F.col("whole").alias("dropped"), F.col("phrase").alias("why")),
    )
    rows = rows.select(*TAKE, "pos", "a", "text", "folded_chars", F.explode(kinds).alias("k")).select(*TAKE, "pos", "a", "text", "folded_chars", "k.*")
    totals = rows.groupBy("config", "filter").agg(
        F.count("*").alias("segments"), F.count_if("dropped").alias("dropped"), F.count_if(F.col("hit") & ~F.col("dropped")).alias("partial"),
        F.sum(F.when(F.col("dropped"), F.col("folded_chars")).otherwise(0)).alias("chars"),
    )
    first = scoring.top(rows.where("dropped"), ["config", "filter"], [F.col(c) for c in ("stem", "reel", "pos")], 3)
    first = first.groupBy("config", "filter").agg(F.array_sort(F.collect_list(F.struct("stem", "reel", "pos", "a", "why", tx.trimmed(F.col("text")).alias("text")))).alias("examples"))
    return totals.join(first, ["config", "filter"], "left")


def filtered_segments(spark: SparkSession, d: str) -> DataFrame:
    """The copy without loops that is scored again."""
    return dt.loops(segments(spark, d)).where("loop is null").select("seg_id", *TAKE, "pos", "a", "b", "text")


#: Cases of the stock phrases: the phrase, two characters more, three more, and speech that shares an ending.
CASES = [c for i, p in enumerate(dt.PHRASES) for c in ((10 * i, p), (10 * i + 1, f"{p}ねえ"), (10 * i + 2, f"{p}ねえと"), (10 * i + 3, p[-4:]), (10 * i + 4, f" {p} "))]


def phrase_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(CASES, "seg_id bigint, text string")
    return dt.phrases(rows, fold=False).select("seg_id", "phrase", "whole")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """The events of a user as labelled spans: from the event on for its value in minutes."""
    at = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, d, "events").select(F.col("user_id").alias("stem"), F.col("event_type").alias("label"), at.alias("a"), (at + F.round(F.col("value") * 60000).cast("bigint")).alias("b"))


def label_totals(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds of every label."""
    return _labelled(spark, d).groupBy("label").agg(F.count("*").alias("regions"), F.sum(F.col("b") - F.col("a")).alias("ms"))


def labelled_regions(spark: SparkSession, d: str) -> DataFrame:
    """The merged regions of the labels that count as speech."""
    return iv.merge(dt.labelled(_labelled(spark, d), "label", SPEECH), ["stem"])


def wall_clocks(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    return s.select("seg_id", tx.wall_clock(F.col("a") * 97).alias("clock"))


def names_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Names as a file and a narrow column of a report take them."""
    t = table(spark, d, "documents").select("doc_id", "title").where("title is not null")
    return t.select("doc_id", tx.slug(F.col("title")).alias("slug"), tx.short(F.col("title"), 12).alias("short"))


def _whole(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return outputs.documents(segments(spark, d), TAKE, kind)

    query.__name__ = f"{kind}_documents"
    return query


def _information(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcripts").groupBy(*TAKE).agg(F.max("lang").alias("language"), F.max("duration").alias("duration"))


def json_documents(spark: SparkSession, d: str) -> DataFrame:
    return outputs.json_documents(worded(spark, d), _information(spark, d), TAKE)


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """The JSON files read again by the transcripts' schema: a round trip of what they hold."""
    r = json_documents(spark, d).select(*TAKE, F.from_json("document", FILE).alias("f")).select(*TAKE, "f.language", "f.duration", F.posexplode("f.segments").alias("n", "s"))
    return r.select(*TAKE, F.col("n").cast("bigint").alias("n"), "language", "duration", "s.id", F.round(F.col("s.start") * 1000).cast("bigint").alias("a"), F.round(F.col("s.end") * 1000).cast("bigint").alias("b"), "s.text", F.coalesce(F.size("s.words"), F.lit(0)).alias("words"))


QUERIES = {
    f.__name__: f
    for f in (
        gap_scores, gap_examples, top_holes, top_speakers, suspect_names, filter_stats, filtered_segments, phrase_cases, label_totals, labelled_regions, wall_clocks, names_of_files,
        *map(_whole, ("vtt", "txt", "tsv", "lrc")), json_documents, json_rows,
    )
}

_GAPS = f"""{CUE}, {SPOKEN}, sp as (select stem, reel, a, speech_end b from spoken where has_text), {merged("sp", "stem, reel")},
dur as (select stem, reel, cast(round(max(duration) * 1000) as bigint) total from transcripts where duration is not null group by all),
gp as (select stem, reel, coalesce(greatest(lag(b) over (partition by stem, reel order by a), 0), 0) a, a b from mrg
 union all select stem, reel, m, total from (select stem, reel, greatest(max(b), 0) m from mrg group by all) join dur using (stem, reel))"""
_HITS = f"""{SEG}, {_GAPS}, g as (select * from gp where b - a > {GAP_MS}),
h0 as (select s.*, greatest(0, s.b - s.a) ms from seg s join g on s.stem = g.stem and s.reel = g.reel and s.a + s.b >= 2 * g.a and s.a + s.b < 2 * g.b),
h as (select *, {text.BARE.format(text._MARKED)} said from h0)"""
_LABELLED = "ev as (select user_id stem, event_type label, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000 a, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000 + cast(round(value * 60000) as bigint) b from events)"
_CASES = ", ".join(f"({i}, '{t}')" for i, t in CASES)
_NUM, _STAMP, _LINED, _SRT = text._NUM, text._STAMP, text._LINED, text._SRT
#: The fold of consecutive duplicates, a row of every recording a step.
_DEDUPE = f"""with recursive {SEG}, s as (select seg_id, config, stem, reel, {text._TRIMMED} t, row_number() over (partition by config, stem, reel order by pos) n from seg),
f(config, stem, reel, n, seg_id, last, times) as (
 select config, stem, reel, n, seg_id, t, 0 from s where n = 1
 union all
 select s.config, s.stem, s.reel, s.n, s.seg_id, case when x.hit then f.last else s.t end, case when x.hit then f.times + 1 else 0 end
 from f join s on s.config = f.config and s.stem = f.stem and s.reel = f.reel and s.n = f.n + 1,
 lateral (select s.t <> '' and f.last <> '' and (s.t = f.last or (length(replace(replace(s.t, ' ', ''), '　', '')) > 10 and len(list_distinct(string_split(replace(replace(s.t, ' ', ''), '　', ''), ''))) <= 2)) hit) x)
select seg_id, times < 2 kept from f"""
#: The greedy fold of captions into blocks, a caption of every file a step.
_BLOCKS = f"""with recursive {CUE}, {SPOKEN}, s as (select stem, reel, a, speech_end b, text, not has_text or regexp_matches(text, '{tx.MUSIC}') skip, row_number() over (partition by stem, reel order by pos, a) n from spoken),
f(stem, reel, n, block, cur, op, start, reach) as (
 select stem, reel, n, case when not skip then 0 end, case when not skip and b - a >= 30000 then 1 else 0 end, not skip and b - a < 30000, a, case when not skip and b - a < 30000 then b end from s where n = 1
 union all
 select s.stem, s.reel, s.n, case when not s.skip then x.c end,
  case when s.skip then f.cur + f.op::int else x.c + (greatest(coalesce(f.reach, s.b), s.b) - x.start >= 30000)::int end,
  not s.skip and greatest(coalesce(f.reach, s.b), s.b) - x.start < 30000, x.start,
  case when not s.skip and greatest(coalesce(f.reach, s.b), s.b) - x.start < 30000 then greatest(coalesce(f.reach, s.b), s.b) end
 from f join s on s.stem = f.stem and s.reel = f.reel and s.n = f.n + 1,
 lateral (select f.op and f.reach is not null and s.a - f.reach > 2000 away) y,
 lateral (select f.cur + y.away::int c, case when f.op and not y.away then f.start else s.a end start) x)
select f.stem, f.reel, cast(block as bigint) block, arg_min(s.a, s.n) a, max(s.b) b, string_agg(text, '' order by s.n) reference from f join s using (stem, reel, n) where block is not null group by all"""

SQL = {
    "gap_scores": f"""with {_HITS}, gg as (select stem, reel, count(*) gaps, cast(sum(b - a) as bigint) gap_ms from g group by all),
hh as (select config, stem, reel, count(*) segments, cast(sum(ms) as bigint) ms, cast(sum(length(said)) as bigint) chars from h group by all), c as (select distinct stem, reel from cues)
select t.config, t.stem, t.reel, c.stem is not null captioned, coalesce(gaps, 0) gaps, coalesce(gap_ms, 0) gap_ms, coalesce(segments, 0) segments, coalesce(ms, 0) ms, coalesce(chars, 0) chars,
case when gap_ms > 0 then coalesce(segments, 0) * 60000 / gap_ms else 0 end per_minute
from (select distinct config, stem, reel from seg) t left join c on c.stem = t.stem and c.reel = t.reel left join gg on gg.stem = t.stem and gg.reel = t.reel
left join hh on hh.config = t.config and hh.stem = t.stem and hh.reel = t.reel""",
    "gap_examples": f"""with {_HITS}, r as (select *, row_number() over (partition by config, stem, reel order by ms desc, a, pos) k from h where said <> '') select config, stem, reel, seg_id, ms from r where k <= 3""",
    "top_holes": f"""with {_GAPS}, r as (select *, row_number() over (partition by stem, reel order by b - a desc, a) k from gp where b - a > {HOLE_MS}) select stem, reel, a, b from r where k <= 4""",
    "top_speakers": f"""with {CUE}, l as (select stem, reel, unnest(string_split(text, chr(10))) text from cue), m as (select stem, reel, {text._TRIMMED} l from l),
e as (select stem, reel, regexp_extract(l, '{scoring.BRACKET_LABEL}', 1) x, regexp_extract(l, '{scoring.COLON_LABEL}', 1) y from m),
n as (select stem, reel, case when x <> '' then x else y end label, count(*) n from e where x <> '' or y <> '' group by all),
r as (select *, row_number() over (partition by stem, reel order by n desc, label) k from n) select stem, reel, label, n from r where k <= 5""",
    "phrase_cases": f"""with c(seg_id, text) as (values {_CASES}), b as (select seg_id, regexp_replace(text, '[{WS}]+', '', 'g') t from c), p as (select seg_id, t, case {text._PHRASES} end phrase from b)
select cast(seg_id as bigint) seg_id, phrase, phrase is not null and length(t) <= length(phrase) + 2 whole from p""",
    "label_totals": f"with {_LABELLED} select label, count(*) regions, cast(sum(b - a) as bigint) ms from ev group by label",
    "labelled_regions": f"with {_LABELLED}, {merged('ev', 'stem', where='a < b and label in ' + repr(SPEECH))} select * from mrg",
    "wall_clocks": f"""with {SEG} select seg_id, printf('%02d:%02d:%02d', greatest(a * 97, 0) // 1000 % 86400 // 3600, greatest(a * 97, 0) // 1000 // 60 % 60, greatest(a * 97, 0) // 1000 % 60) clock from seg""",
    "names_of_files": """select doc_id, coalesce(nullif(regexp_replace(regexp_replace(title, '[^\\p{L}\\p{N}._-]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'model') slug,
case when length(title) <= 12 then title else substr(title, 1, 11) || '…' end short from documents where title is not null""",
    "vtt_documents": f"with {_NUM} select config, stem, reel, 'WEBVTT' || chr(10) || chr(10) || string_agg({_SRT.replace('02d,%03d', '02d.%03d')}, '' order by number) document from nm group by all",
    "txt_documents": f"with {_NUM} select config, stem, reel, string_agg({_LINED} || chr(10), '' order by number) document from nm group by all",
    "tsv_documents": f"""with {_NUM} select config, stem, reel, 'start' || chr(9) || 'end' || chr(9) || 'text' || chr(10) || string_agg(printf('%d.%03d', a // 1000, a % 1000) || chr(9) || printf('%d.%03d', b // 1000, b % 1000) || chr(9) || {_LINED} || chr(10), '' order by number) document
from nm group by all""",
    "lrc_documents": f"with {_NUM} select config, stem, reel, string_agg(printf('[%02d:%02d.%02d]', a // 60000, (a % 60000 + 5) // 10 // 100, (a % 60000 + 5) // 10 % 100) || {_LINED} || chr(10), '' order by number) document from nm group by all",
    "json_rows": f"""with {SEG}, i as (select config, stem, reel, max(lang) lang, max(duration) duration from transcripts group by all), w as (select seg_id, any_value(len(words)) words from segments group by seg_id)
select seg.config, seg.stem, seg.reel, row_number() over (partition by seg.config, seg.stem, seg.reel order by pos, seg_id) - 1 n, coalesce(lang, '') "language", round(coalesce(duration, 0), 3) duration, id, a, b, text, cast(coalesce(words, 0) as int) words
from seg left join i on i.config = seg.config and i.stem = seg.stem and i.reel = seg.reel join w using (seg_id)""",
    "dedupe_fold": _DEDUPE,
    "greedy_blocks": _BLOCKS,
}
