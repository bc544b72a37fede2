"""Queries of text, detectors, distances, layout and outputs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelight.functions import text as tx
from cuelight.operators import detectors as dt
from cuelight.operators import distance, resegment, scoring
from cuelight.operators.intervals import merge, overlapping, points_in
from cuelight.plans.base import BARE, CUE, REEL, REG, SEG, SPOKEN, TAKE, WS, cues, merged, regions, segments, worded
from cuelight.session import table
from cuelight.sources import outputs

ASCII = "^[\\x00-\\x7f]*$"


def ascii_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d).where(F.col("text").rlike(ASCII))
    bare = F.regexp_replace(tx.without_markup(F.col("text")), f"[{tx.PUNCTUATION}]", "")
    return rows.select("cue_id", tx.squeeze(F.col("text")).alias("asis"), tx.squeeze(tx.without_markup(F.col("text"))).alias("markup"), bare.alias("plain"))


def cue_levels(spark: SparkSession, d: str) -> DataFrame:
    """Every cue at every level, of whatever script; ``ascii_normalize`` is the part of it that DuckDB can say."""
    return cues(spark, d).select("cue_id", *(tx.normalised(F.col("text"), n).alias(n) for n in tx.LEVELS))


def nfkc_plain(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("seg_id", tx.normalised(F.col("text"), "plain").alias("plain"))


def one_line_text(spark: SparkSession, d: str) -> DataFrame:
    return cues(spark, d).select("cue_id", tx.one_line(F.col("text")).alias("line"))


def speech_budget(spark: SparkSession, d: str) -> DataFrame:
    return scoring.speech_spans(cues(spark, d)).select("cue_id", "has_text", "speech_end", "speech_ms", "screen_ms", "held_ms")


def sung_cues(spark: SparkSession, d: str) -> DataFrame:
    return cues(spark, d).where(tx.sung(F.col("text"))).select("cue_id")


def distinct_char_rule(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).where(dt.distinct_rule(tx.squeeze(F.col("text")))).select("seg_id")


def char_run_rule(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).where(dt.run_rule(tx.squeeze(F.col("text")))).select("seg_id")


def loop_filter(spark: SparkSession, d: str) -> DataFrame:
    return dt.loops(segments(spark, d)).where("loop is not null").select("seg_id", "loop", "folded_chars")


def score_loops(spark: SparkSession, d: str) -> DataFrame:
    return dt.score_loops(segments(spark, d)).where("loop").select("seg_id", "plain_chars")


def phrase_filter(spark: SparkSession, d: str) -> DataFrame:
    return dt.phrases(segments(spark, d), fold=False).where("phrase is not null").select("seg_id", "phrase", "whole")


def stock_phrases(spark: SparkSession, d: str) -> DataFrame:
    return dt.phrases(segments(spark, d)).where("phrase is not null").select("seg_id", "phrase", "whole")


def _anomalies(spark: SparkSession, d: str) -> DataFrame:
    return dt.anomalies(segments(spark, d), F.length(tx.squeeze(F.col("text"))))


def density_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return _anomalies(spark, d).where("dense").select("seg_id", "ms", "chars", "rate")


def thin_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return _anomalies(spark, d).where("thin").select("seg_id", "ms", "chars")


def over30_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return _anomalies(spark, d).where("over30").select("seg_id", "ms")


def anomaly_totals(spark: SparkSession, d: str) -> DataFrame:
    r = _anomalies(spark, d)
    sets = [[F.col("config"), F.col("stem")], [F.col("config")]]
    return r.groupingSets(sets, F.col("config"), F.col("stem")).agg(
        F.count("*").alias("segments"), F.count_if("dense").alias("dense"), F.count_if("thin").alias("thin"), F.count_if("over30").alias("over30"),
        F.sum(F.when(F.col("over30"), F.col("ms")).otherwise(0)).cast("bigint").alias("over30_ms"), F.max("ms").alias("longest_ms"), F.max("rate").alias("densest"),
    )


def first_anomalies(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.filter(F.array(*(F.when(F.col(k), F.lit(f"{i}{k}")) for i, k in enumerate(("over30", "thin", "dense")))), lambda x: x.isNotNull())
    r = _anomalies(spark, d).select("config", "stem", "reel", "pos", "seg_id", F.explode(kinds).alias("k"))
    r = scoring.top(r, ["config", "stem"], [F.col("reel"), F.col("pos"), F.col("k")], 3)
    return r.select("config", "stem", "seg_id", F.substring("k", 2, 9).alias("kind"))


def clip_lists(spark: SparkSession, d: str) -> DataFrame:
    m = merge(regions(spark, d), ["backend", *REEL]).select("backend", *REEL, "a", F.format_string("%d.%03d,%d.%03d", *(x.cast("bigint") for c in ("a", "b") for x in (F.floor(F.col(c) / 1000), F.col(c) % 1000))).alias("clip"))
    return scoring.joined_text(m, ["backend", *REEL], ["a"], "clip", ",")


def output_names(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcripts").select("config", "stem", "reel", F.lower("lang").alias("lang")).distinct()
    return t.select("config", "stem", "reel", F.concat_ws(".", F.concat_ws("_", "stem", F.col("reel").cast("string")), "lang", F.lit("srt")).alias("name"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain behind recognition: duplicates, loops and stock phrases go, then repair, then layout."""
    s = worded(spark, d)
    kept = dt.repeated_runs(segments(spark, d), TAKE, ["pos"]).where("kept").select("seg_id")
    s = dt.loops(s.join(kept, "seg_id", "left_semi")).where("loop is null")
    s = dt.phrases(s).where("not whole").drop("loop", "folded_chars", "phrase", "whole")
    fixed = resegment.sanitised(s, TAKE).withColumn("pos", F.col("id"))
    width, lines, parted = resegment.PRESETS["standard"]
    return resegment.formatted(fixed, TAKE, width, lines, parted, 3.0).drop("words")


def drop_stats(spark: SparkSession, d: str) -> DataFrame:
    r = segments(spark, d).withColumn("t", tx.squeeze(F.col("text"))).withColumn("hit", dt.distinct_rule(F.col("t")) | dt.run_rule(F.col("t")))
    r = r.groupBy("config").agg(F.count("*").alias("before"), F.count_if(~F.col("hit")).alias("after"), F.count_if("hit").alias("dropped"), F.sum(F.when(F.col("hit"), F.length("t")).otherwise(0)).cast("bigint").alias("chars"))
    return r.withColumn("share", F.col("dropped") / F.col("before"))


def loop_drop_stats(spark: SparkSession, d: str) -> DataFrame:
    """What leaving out loops by each detector drops, all rules counted, by transcript and configuration (``total`` = 1).
    ``share`` is of the text, in characters at the plain level."""
    r = dt.score_loops(segments(spark, d)).withColumnRenamed("loop", "score")
    r = dt.loops(r).select(*TAKE, "plain_chars", "score", F.col("loop").isNotNull().alias("production"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("detector"), F.col(k).alias("hit")) for k in ("score", "production"))))
    r = r.select(*TAKE, "plain_chars", kinds.alias("k")).select(*TAKE, "plain_chars", "k.*")
    keys = [F.col(c) for c in ("detector", *TAKE)]
    r = r.groupingSets([keys, keys[:2]], *keys).agg(
        F.grouping("stem").cast("int").alias("total"), F.count("*").alias("before"), F.count_if(~F.col("hit")).alias("after"), F.count_if("hit").alias("dropped"),
        F.sum("plain_chars").alias("chars"), F.sum(F.when(F.col("hit"), F.col("plain_chars")).otherwise(0)).alias("dropped_chars"),
    )
    return r.withColumn("share", F.when(F.col("chars") > 0, F.col("dropped_chars") / F.col("chars")).otherwise(0.0))


def dedupe_fold(spark: SparkSession, d: str) -> DataFrame:
    return dt.repeated_runs(segments(spark, d), TAKE, ["pos"])


def dedupe_equal(spark: SparkSession, d: str) -> DataFrame:
    """The same filter's second and later repetitions of a text that stands directly after itself."""
    by = Window.partitionBy(*TAKE).orderBy("pos")
    s = segments(spark, d).withColumn("t", tx.trimmed(F.col("text")))
    same = (F.col("t") != "") & (F.col("t") == F.lag("t").over(by)) & (F.col("t") == F.lag("t", 2).over(by))
    return s.withColumn("hit", same).where("hit").select("seg_id")


def file_selection(spark: SparkSession, d: str) -> DataFrame:
    return dt.selected(table(spark, d, "transcripts").select("config", "stem", "reel").distinct(), "stem", ["marathon", "kaze"], ["yuki", "ren"])


def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return dt.first_delivery(table(spark, d, "segments"), ["seg_id"], ["received_at"]).select("seg_id", "received_at")


def language_warning(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcripts").select("config", "stem", "reel", "lang", "lang_probability").distinct()
    return t.withColumn("warn", F.coalesce(F.col("lang_probability") < 0.70, F.lit(False))).where("warn").drop("warn")


def duration_fallback(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcripts").select("config", "stem", "reel", "duration").distinct()
    twin = t.groupBy(*REEL).agg(F.max("duration").alias("twin"))
    return t.join(twin, REEL, "left").select("config", "stem", "reel", F.coalesce("duration", "twin").alias("duration")).where("duration is not null")


def pseudo_word_timing(spark: SparkSession, d: str) -> DataFrame:
    """Words of texts without word times, by the characters before them; in whole milliseconds, halves up."""
    s = worded(spark, d).where("(words is null or size(words) = 0) and start_s is not null and end_s > start_s and text is not null").where(F.col("text").rlike(ASCII))
    s = s.select("seg_id", F.round(F.col("start_s") * 1000).cast("bigint").alias("a"), F.round(F.col("end_s") * 1000).cast("bigint").alias("b"), F.regexp_extract_all("text", F.lit("\\s*\\S+"), F.lit(0)).alias("u"))
    s = s.select("seg_id", "a", "b", F.posexplode("u").alias("n", "word")).withColumn("size", F.length("word").cast("bigint"))
    by = Window.partitionBy("seg_id")
    upto = by.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("total", F.sum("size").over(by)).withColumn("done", F.sum("size").over(upto))
    at = "cast(a + floor((2 * (b - a) * ({0}) + total) / (2 * total)) as bigint)"
    return s.select("seg_id", F.col("n").cast("bigint").alias("n"), "word", F.expr(at.format("done - size")).alias("start_ms"), F.expr(at.format("done")).alias("end_ms"))


def word_timing(spark: SparkSession, d: str) -> DataFrame:
    """Words of all texts without word times: characters of spaceless languages (by the transcript's language, else by the
    text), words with the white space before them elsewhere, spread over the segment by their lengths."""
    lang = table(spark, d, "transcripts").groupBy(*TAKE).agg(F.max("lang").alias("lang"))
    s = worded(spark, d).where("text is not null").join(lang, TAKE, "left")
    return resegment.imagined_words(s)


def gap_split_groups(spark: SparkSession, d: str) -> DataFrame:
    w = worded(spark, d).select("seg_id", F.posexplode("words").alias("n", "w"))
    w = w.where("w.word is not null and w.start_s is not null and w.end_s is not null").where(tx.squeeze(F.col("w.word")) != "")
    w = w.select("seg_id", "n", F.round(F.col("w.start_s") * 1000).cast("bigint").alias("a"), F.round(F.col("w.end_s") * 1000).cast("bigint").alias("b"))
    by = Window.partitionBy("seg_id").orderBy("n")
    w = w.withColumn("fresh", F.coalesce(F.col("a") - F.lag("b").over(by) > 3000, F.lit(False))).withColumn("part", F.count_if("fresh").over(by))
    return w.groupBy("seg_id", "part").agg(F.count("*").alias("words"), F.min_by("a", "n").alias("start_ms"), F.max_by("b", "n").alias("end_ms"))


def renumber(spark: SparkSession, d: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*TAKE).orderBy("a", "pos")) - 1
    return segments(spark, d).select("seg_id", number.cast("bigint").alias("id"))


def sanitize(spark: SparkSession, d: str) -> DataFrame:
    return resegment.sanitised(worded(spark, d), TAKE).drop("words")


def sanitize_stats(spark: SparkSession, d: str) -> DataFrame:
    r = resegment.sanitised(worded(spark, d), TAKE)
    one = r.groupBy(*TAKE, "seg_id").agg(F.max("split").alias("split"), F.max("clamped").alias("clamped"), F.max("capped").alias("capped"), F.count("*").alias("parts"), F.max(F.col("end_s") - F.col("start_s")).alias("longest"))
    return one.groupBy(*TAKE).agg(F.count_if("split").alias("split"), F.count_if("clamped").alias("clamped"), F.count_if("capped").alias("capped"), F.sum(F.col("parts") - 1).alias("added"), F.max("longest").alias("longest_after"))


def format_wrap(spark: SparkSession, d: str) -> DataFrame:
    width, lines, parted = resegment.PRESETS["standard_asia"]
    return resegment.formatted(worded(spark, d), TAKE, width, lines, parted, 3.0).drop("words")


def greedy_blocks(spark: SparkSession, d: str) -> DataFrame:
    return scoring.blocks(cues(spark, d), REEL)


def _pairs(spark: SparkSession, d: str, ascii_only: bool = True) -> DataFrame:
    c = scoring.speech_spans(cues(spark, d)).where("has_text and speech_end > a")
    s = segments(spark, d)
    if ascii_only:
        c, s = c.where(F.col("text").rlike(ASCII)), s.where(F.col("text").rlike(ASCII))
    hits = points_in(s, c.select("cue_id", *REEL, "a", F.col("speech_end").alias("b")), REEL, F.col("a") + F.col("b"))
    said = scoring.joined_text(hits, ["config", "cue_id"], ["a", "pos"], "text").withColumnRenamed("text", "hyp")
    return c.select("cue_id", "stem", F.col("text").alias("ref")).join(said, "cue_id")


def edit_distance_ascii(spark: SparkSession, d: str) -> DataFrame:
    p = distance.pair_scores(_pairs(spark, d), tx.squeeze(F.col("ref")), tx.squeeze(F.col("hyp")), common=False)
    return p.select("config", "cue_id", "ref_chars", "hyp_chars", "edits")


def cer_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = distance.pair_scores(_pairs(spark, d), tx.squeeze(F.col("ref")), tx.squeeze(F.col("hyp")), common=False)
    return distance.rolled_up(p, ["config"], ["stem"]).select("config", "stem", "total", "blocks", "ref_chars", "hyp_chars", "edits", "cer", "length_ratio")


def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    """Edits of every cue that has a hypothesis, of whatever script."""
    p = distance.pair_scores(_pairs(spark, d, False), tx.squeeze(F.col("ref")), tx.squeeze(F.col("hyp")), common=False)
    return p.select("config", "cue_id", "ref_chars", "hyp_chars", "edits")


def cer_totals(spark: SparkSession, d: str) -> DataFrame:
    """The edits of ``edit_distance`` summed by file and configuration."""
    p = distance.pair_scores(_pairs(spark, d, False), tx.squeeze(F.col("ref")), tx.squeeze(F.col("hyp")), common=False)
    return distance.rolled_up(p, ["config"], ["stem"]).select("config", "stem", "total", "blocks", "ref_chars", "hyp_chars", "edits", "cer", "length_ratio")


def block_scores(spark: SparkSession, d: str) -> DataFrame:
    """Errors of every block at every level, summed by file and configuration, with what dominates."""
    b = scoring.blocks(cues(spark, d), REEL)
    p = distance.levels(scoring.block_texts(b, segments(spark, d), REEL), "reference", "hypothesis")
    p = distance.pair_scores(p, F.col("reference"), F.col("hypothesis"))
    r = distance.rolled_up(p, ["config", "level"], ["stem"])
    return r.withColumn("dominant", distance.diagnosis(F.col("coverage"), F.col("precision")))


def whole_scores(spark: SparkSession, d: str) -> DataFrame:
    """Errors of each reel's captioned stretches as one text, at the plain level."""
    b = scoring.blocks(cues(spark, d), REEL)
    said = scoring.joined_text(overlapping(segments(spark, d), b, REEL), TAKE, ["a", "pos"], "text").withColumnRenamed("text", "hyp")
    ref = scoring.joined_text(b.withColumnRenamed("reference", "text"), REEL, ["block"], "text").withColumnRenamed("text", "ref")
    p = said.join(ref, REEL)
    return distance.pair_scores(p, tx.normalised(F.col("ref")), tx.normalised(F.col("hyp")), long=True).drop("ref", "hyp")


def survey_counts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.survey(cues(spark, d), REEL)


def survey_speakers(spark: SparkSession, d: str) -> DataFrame:
    return scoring.survey_labels(cues(spark, d), REEL)


def suspect_chars(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top(scoring.suspects(cues(spark, d), ["stem"]), ["stem"], [F.col("n").desc(), F.col("ch")], 6)


def timestamp_format(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    return s.select("seg_id", tx.timestamp(F.col("a")).alias("srt"), tx.timestamp(F.col("a"), ".").alias("vtt"), tx.clock(F.col("a")).alias("clock"))


def _kind(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return outputs.parts(segments(spark, d), TAKE, kind).select("seg_id", "part")

    query.__name__ = f"{kind}_parts"
    return query


def srt_documents(spark: SparkSession, d: str) -> DataFrame:
    return outputs.documents(segments(spark, d), TAKE, "srt")


QUERIES = {
    f.__name__: f
    for f in (
        ascii_normalize, cue_levels, nfkc_plain, one_line_text, speech_budget, sung_cues, distinct_char_rule, char_run_rule, loop_filter, score_loops, phrase_filter, stock_phrases,
        density_anomaly, thin_anomaly, over30_anomaly, anomaly_totals, first_anomalies, clip_lists, output_names, pipeline, drop_stats, loop_drop_stats, dedupe_fold, dedupe_equal, file_selection, first_wins_dedupe, language_warning,
        duration_fallback, pseudo_word_timing, word_timing, gap_split_groups, renumber, sanitize, sanitize_stats, format_wrap, greedy_blocks, edit_distance_ascii, cer_rollup, edit_distance, cer_totals,
        block_scores, whole_scores, survey_counts, survey_speakers, suspect_chars, timestamp_format, *map(_kind, ("srt", "vtt", "txt", "tsv", "lrc")), srt_documents,
    )
}


def _lit(s: str) -> str:
    return s.replace("'", "''")


_P = _lit(tx.PUNCTUATION)
_MARK = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '" + tx.PRIVATE + "', '', 'g'), chr(13) || chr(10) || '?', chr(10), 'g'),"
    " '(?m)^[" + WS + "]+|[" + WS + "]+$', '', 'g'), '" + tx.LABEL + "', '', 'g'), '" + tx.PARENTHETICAL + "', '', 'g'), '" + tx.NARRATION + "', '', 'g'), '" + tx.SYMBOLS + "', '', 'g')"
)
_TRIM = "regexp_replace({0}, '^[" + WS + "]+|[" + WS + "]+$', '', 'g')"
_LINE = "trim(regexp_replace({0}, '[" + WS + "]+', ' ', 'g'))"
_MARKED, _BARE, _LINED, _TRIMMED = _MARK.replace("{0}", "text"), BARE.format("text"), _LINE.format("text"), _TRIM.format("text")
_DISTINCT = "length({0}) >= 12 and len(list_distinct(string_split({0}, ''))) <= 2".format("t")
_RUN = """ch as (select seg_id, unnest(string_split(t, '')) c, unnest(range(1, length(t) + 1)) n from bare where t <> ''),
cr as (select seg_id, n - row_number() over (partition by seg_id, c order by n) k, c from ch), rn as (select distinct seg_id from (select seg_id, c, k from cr group by all having count(*) >= 8))"""
_ANOM = f"""{SEG}, an0 as (select *, greatest(0, b - a) ms, length({_BARE}) chars from seg), an as (select *, ms > 30000 over30, ms >= 20000 and chars * 1000 < ms thin,
ms >= 50 and chars > 0 and chars * 1000 > 15 * ms and chars >= 20 dense, case when ms >= 50 and chars > 0 then chars * 1000 / ms end rate from an0)"""
_PAIR = f"""{SEG}, {CUE}, {SPOKEN}, c as (select cue_id, stem, reel, a, speech_end b, text ref from spoken where has_text and speech_end > a and regexp_full_match(text, '[\\x00-\\x7f]*')),
h as (select config, cue_id, string_agg(text, '' order by s.a, s.pos, text) hyp from seg s join c on s.stem = c.stem and s.reel = c.reel and s.a + s.b >= 2 * c.a and s.a + s.b < 2 * c.b
 where regexp_full_match(text, '[\\x00-\\x7f]*') group by all),
p as (select config, cue_id, stem, {BARE.format("ref")} r, {BARE.format("hyp")} h from h join c using (cue_id)),
sc as (select config, cue_id, stem, length(r) ref_chars, length(h) hyp_chars, case when r = '' then 0 else levenshtein(r, h) end edits from p)"""
_PHRASES = " ".join(f"when contains(t, '{p}') then '{p}'" for p in dt.PHRASES)
_STAMP = "printf('%02d:%02d:%02d{1}%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_NUM = f"{SEG}, nm as (select *, row_number() over (partition by config, stem, reel order by pos, seg_id) number from seg)"
_SRT = f"number || chr(10) || {_STAMP.format('a', ',')} || ' --> ' || {_STAMP.format('b', ',')} || chr(10) || {_TRIMMED} || chr(10) || chr(10)"

SQL = {
    "ascii_normalize": f"""with {CUE} select cue_id, {_BARE} asis, {BARE.format(_MARKED)} markup, regexp_replace({_MARKED}, '[{_P}]', '', 'g') plain from cue where regexp_full_match(text, '[\\x00-\\x7f]*')""",
    "one_line_text": f"with {CUE} select cue_id, {_LINED} line from cue",
    "speech_budget": f"with {CUE}, {SPOKEN} select cue_id, has_text, speech_end, greatest(0, speech_end - a) speech_ms, greatest(0, b - a) screen_ms, greatest(0, b - speech_end) held_ms from spoken",
    "sung_cues": f"""with {CUE}, l as (select *, {_TRIM.format(_MARKED)} rest from cue) select cue_id from l where rest <> ''
and (regexp_matches(text, '{tx.MUSIC}') or regexp_matches(rest, '{tx.INSTRUMENTAL}') or regexp_matches(rest, '{tx.LYRICS}'))""",
    "distinct_char_rule": f"with {SEG}, bare as (select seg_id, {_BARE} t from seg) select seg_id from bare where {_DISTINCT}",
    "char_run_rule": f"with {SEG}, bare as (select seg_id, {_BARE} t from seg), {_RUN} select seg_id from rn",
    "phrase_filter": f"""with {SEG}, bare as (select seg_id, {_BARE} t from seg), p as (select seg_id, t, case {_PHRASES} end phrase from bare)
select seg_id, phrase, length(t) <= length(phrase) + 2 whole from p where phrase is not null""",
    "density_anomaly": f"with {_ANOM} select seg_id, ms, chars, rate from an where dense",
    "thin_anomaly": f"with {_ANOM} select seg_id, ms, chars from an where thin",
    "over30_anomaly": f"with {_ANOM} select seg_id, ms from an where over30",
    "anomaly_totals": f"""with {_ANOM} select config, stem, count(*) segments, count(*) filter (where dense) dense, count(*) filter (where thin) thin, count(*) filter (where over30) over30,
cast(sum(case when over30 then ms else 0 end) as bigint) over30_ms, max(ms) longest_ms, max(rate) densest from an group by grouping sets ((config, stem), (config))""",
    "first_anomalies": f"""with {_ANOM}, k as (select config, stem, reel, pos, seg_id, unnest([case when over30 then '0over30' end, case when thin then '1thin' end, case when dense then '2dense' end]) k from an),
r as (select *, row_number() over (partition by config, stem order by reel, pos, k) n from k where k is not null) select config, stem, seg_id, substr(k, 2) kind from r where n <= 3""",
    "clip_lists": f"""with {REG}, {merged("reg", "backend, stem, reel")}
select backend, stem, reel, string_agg(printf('%d.%03d,%d.%03d', a // 1000, a % 1000, b // 1000, b % 1000), ',' order by a) clip from mrg group by all""",
    "output_names": "select distinct config, stem, reel, concat_ws('.', stem || '_' || reel, lower(lang), 'srt') name from transcripts",
    "drop_stats": f"""with {SEG}, bare as (select config, seg_id, {_BARE} t from seg), {_RUN}, f as (select b.*, ({_DISTINCT}) or r.seg_id is not null hit from bare b left join rn r using (seg_id))
select config, count(*) before, count(*) filter (where not hit) after, count(*) filter (where hit) dropped, cast(sum(case when hit then length(t) else 0 end) as bigint) chars,
count(*) filter (where hit) / count(*) share from f group by config""",
    "dedupe_equal": f"""with {SEG}, s as (select *, {_TRIMMED} t from seg), w as (select seg_id, t, lag(t) over o x, lag(t, 2) over o y from s window o as (partition by config, stem, reel order by pos))
select seg_id from w where t <> '' and t = x and t = y""",
    "file_selection": "select distinct config, stem, reel from transcripts where (contains(stem, 'marathon') or contains(stem, 'kaze')) and not (contains(stem, 'yuki') or contains(stem, 'ren'))",
    "first_wins_dedupe": "select seg_id, min(received_at) received_at from segments group by seg_id",
    "language_warning": "select distinct config, stem, reel, lang, lang_probability from transcripts where lang_probability < 0.70",
    "duration_fallback": """with t as (select distinct config, stem, reel, duration from transcripts), w as (select stem, reel, max(duration) twin from t group by all)
select config, t.stem, t.reel, coalesce(duration, twin) duration from t left join w using (stem, reel) where coalesce(duration, twin) is not null""",
    "pseudo_word_timing": """with s as (select distinct seg_id, cast(round(start_s * 1000) as bigint) a, cast(round(end_s * 1000) as bigint) b, text from segments
 where (words is null or len(words) = 0) and start_s is not null and end_s > start_s and text is not null and regexp_full_match(text, '[\\x00-\\x7f]*')),
u as (select seg_id, a, b, unnest(regexp_extract_all(text, '\\s*\\S+')) word, unnest(range(0, len(regexp_extract_all(text, '\\s*\\S+')))) n from s),
z as (select *, length(word) size, sum(length(word)) over (partition by seg_id) total, sum(length(word)) over (partition by seg_id order by n) done from u)
select seg_id, n, word, cast(a + (2 * (b - a) * (done - size) + total) // (2 * total) as bigint) start_ms, cast(a + (2 * (b - a) * done + total) // (2 * total) as bigint) end_ms from z""",
    "gap_split_groups": f"""with s as (select seg_id, any_value(words) words from segments group by seg_id), w as (select seg_id, unnest(words) w, unnest(range(0, len(words))) n from s),
u as (select seg_id, n, cast(round(w.start_s * 1000) as bigint) a, cast(round(w.end_s * 1000) as bigint) b from w where w.word is not null and w.start_s is not null and w.end_s is not null and {BARE.format("w.word")} <> ''),
f as (select *, coalesce(a - lag(b) over (partition by seg_id order by n) > 3000, false) fresh from u),
p as (select *, sum(case when fresh then 1 else 0 end) over (partition by seg_id order by n) part from f)
select seg_id, cast(part as bigint) part, count(*) words, arg_min(a, n) start_ms, arg_max(b, n) end_ms from p group by seg_id, part""",
    "renumber": f"with {SEG} select seg_id, row_number() over (partition by config, stem, reel order by a, pos) - 1 id from seg",
    "edit_distance_ascii": f"with {_PAIR} select config, cue_id, ref_chars, hyp_chars, edits from sc",
    "cer_rollup": f"""with {_PAIR}, g as (select config, stem, grouping(stem) total, count(*) blocks, cast(sum(ref_chars) as bigint) ref_chars, cast(sum(hyp_chars) as bigint) hyp_chars, cast(sum(edits) as bigint) edits
 from sc group by grouping sets ((config, stem), (config)))
select *, case when ref_chars > 0 then edits / ref_chars else 0 end cer, case when ref_chars > 0 then hyp_chars / ref_chars else 0 end length_ratio from g""",
    "survey_counts": f"""with {CUE}, {SPOKEN}, k as (select *, coalesce(a < lag(a) over (partition by stem, reel order by pos), false) back from spoken)
select stem, reel, count(*) cues, count(*) filter (where has_text) text_cues, count(*) filter (where not has_text) empty_cues,
cast(sum(case when has_text then greatest(0, speech_end - a) else 0 end) as bigint) text_ms, cast(sum(case when has_text then greatest(0, b - a) else 0 end) as bigint) screen_ms,
count(*) filter (where has_text and b - speech_end > 500) held_cues, cast(sum(coalesce(len(ruby), 0)) as bigint) ruby_runs, cast(sum(coalesce(drcs, 0)) as bigint) drcs,
cast(sum(length(regexp_replace(text, '[^０-９]', '', 'g'))) as bigint) wide_digits, cast(sum(length(regexp_replace(text, '[^ ]', '', 'g'))) as bigint) spaces,
count(*) filter (where back) out_of_order, count(*) filter (where b <= a) inverted from k group by stem, reel""",
    "survey_speakers": f"""with {CUE}, l as (select stem, reel, unnest(string_split(text, chr(10))) text from cue), m as (select stem, reel, {_TRIMMED} l from l),
e as (select stem, reel, regexp_extract(l, '{scoring.BRACKET_LABEL}', 1) x, regexp_extract(l, '{scoring.COLON_LABEL}', 1) y from m)
select stem, reel, case when x <> '' then 'bracket' else 'colon' end kind, case when x <> '' then x else y end label, count(*) n from e where x <> '' or y <> '' group by all""",
    "suspect_chars": f"""with {CUE}, c as (select stem, unnest(string_split(text, '')) ch from cue), n as (select stem, ch, count(*) n from c where regexp_matches(ch, '[^\\x00-\\x7f぀-ヿ一-鿿　-〿＀-￯]') group by all),
r as (select *, row_number() over (partition by stem order by n desc, ch) k from n) select stem, ch, n from r where k <= 6""",
    "timestamp_format": f"""with {SEG} select seg_id, {_STAMP.format("a", ",")} srt, {_STAMP.format("a", ".")} vtt,
printf('%d:%02d:%02d.%d', (a + 50) // 100 // 36000, (a + 50) // 100 // 600 % 60, (a + 50) // 100 // 10 % 60, (a + 50) // 100 % 10) clock from seg""",
    "srt_parts": f"with {_NUM} select seg_id, {_SRT} part from nm",
    "vtt_parts": f"with {_NUM} select seg_id, {_SRT.replace('02d,%03d', '02d.%03d')} part from nm",
    "txt_parts": f"with {_NUM} select seg_id, {_LINED} || chr(10) part from nm",
    "tsv_parts": f"with {_NUM} select seg_id, printf('%d.%03d', a // 1000, a % 1000) || chr(9) || printf('%d.%03d', b // 1000, b % 1000) || chr(9) || {_LINED} || chr(10) part from nm",
    "lrc_parts": f"with {_NUM} select seg_id, printf('[%02d:%02d.%02d]', a // 60000, (a % 60000 + 5) // 10 // 100, (a % 60000 + 5) // 10 % 100) || {_LINED} || chr(10) part from nm",
    "srt_documents": f"with {_NUM} select config, stem, reel, string_agg({_SRT}, '' order by number) document from nm group by all",
}
