"""Repair and layout of segments by their word times.

What happens to one segment needs no other one, so segments are mapped in Arrow batches; what depends on a recording's order
(that every worded segment after the first repaired one is rebuilt, and the numbering) is a window over the recording.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from cuelight.functions.batches import map_columns
from cuelight.functions.options import PRESETS as LAYOUTS
from cuelight.functions.text import squeeze

#: The longest segment, and the slack of its ends, in seconds.
LONGEST, SLACK = 30.0, 0.05
#: Sentence ends, closers after them, and what may not begin a line.
ENDS = "。．.！!？?…‥"
CLOSERS = "」』｣）)】〉》〕］]｝}”’\"'"
NO_START = "、。，．,.!！？?:;：；）)｝}】」』〉》］]〕｣”’\"'…‥ー々ゝゞぁぃぅぇぉっゃゅょゎゕゖァィゥェォッャュョヮヵヶ"
#: Languages that are written without spaces.
SPACELESS = ("ja", "zh", "yue", "th", "lo", "my", "km")
#: The layouts: width, lines, and whether sentences are parted.
PRESETS = {n: (v["max_line_width"], v["max_line_count"], v["sentence"]) for n, v in LAYOUTS.items()}

_cjk = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]")
WORD = StructType([StructField("word", StringType()), StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("probability", DoubleType())])
PIECE = StructType([StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("text", StringType()), StructField("words", ArrayType(WORD))])


def usable(words: list | None) -> list[dict]:
    """Words with a text and both times, under the names word, start, end, probability."""
    out = []
    for w in words or []:
        if w:
            a, b = (w.get(k, w.get(f"{k}_s")) for k in ("start", "end"))
            if a is not None and b is not None and (w.get("word") or "").strip():
                out.append({"word": w["word"], "start": a, "end": b, "probability": w.get("probability")})
    return out


def shown(words: list[dict]) -> str:
    return "".join(w["word"] for w in words).strip()


def piece(words: list[dict], text: str | None = None) -> dict:
    a, b = words[0]["start"], words[-1]["end"]
    return {"start": round(a, 3), "end": round(b if b > a else a + 0.001, 3), "text": shown(words) if text is None else text, "words": words}


def cut_at(words: list[dict], ends: list[int]) -> list[list[dict]]:
    """The words cut behind the places ``ends``."""
    edges = [0, *(e + 1 for e in ends), len(words)]
    return [words[a:b] for a, b in zip(edges, edges[1:]) if b > a]


def bounded(words: list[dict], longest: float) -> list[list[dict]]:
    """Groups of at most ``longest`` seconds, cut at the widest pause, the first of equal ones; one word is never cut."""
    todo, out = [words], []
    while todo:
        w = todo.pop()
        if len(w) < 2 or w[-1]["end"] - w[0]["start"] <= longest:
            out.append(w)
            continue
        pauses = [y["start"] - x["end"] for x, y in zip(w, w[1:])]
        widest = max(pauses)
        if widest <= -1.0:
            out.append(w)
            continue
        at = pauses.index(widest) + 1
        todo += [w[at:], w[:at]]
    return out


def repair(start: float | None, end: float | None, words: list | None, max_gap: float | None, longest: float) -> tuple[bool, bool, bool, bool, list[dict]]:
    """Whether a segment is changed, clamped, split, capped; and the pieces to which it is rebuilt."""
    a = start or 0.0
    b = a if end is None else end
    real = usable(words)
    if not real:
        capped = b - a > longest
        return capped, False, False, capped, [{"start": start, "end": round(a + longest, 3) if capped else end, "text": None, "words": None}]
    clamped = real[0]["start"] > a + SLACK or real[-1]["end"] < b - SLACK
    ends = [] if max_gap is None else [i for i, (x, y) in enumerate(zip(real, real[1:])) if y["start"] - x["end"] > max_gap]
    groups = [g for part in cut_at(real, ends) for g in bounded(part, longest)]
    split = len(groups) > 1
    return clamped or split, clamped, split, False, [piece(g) for g in groups]


def gap_limit(max_gap: object) -> float | None:
    """A pause in seconds, or None if it is missing, no number, or not above 0."""
    try:
        limit = None if max_gap is None else float(max_gap)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return limit if limit is not None and limit > 0 else None


def sanitised(segments: DataFrame, keys: list[str], max_gap: object = 3.0, longest: float = LONGEST) -> DataFrame:
    """(keys, seg_id, id, start_s, end_s, text, words, clamped, split, capped): the repaired segments of every recording.

    A pause over ``max_gap`` splits a segment, and none stays longer than ``longest`` unless it is one word. From the first
    repaired segment of a recording on, worded segments are rebuilt from their words; ids are renumbered from 0 if anything
    was repaired, else they stay. Segments without usable words are only capped.
    """
    limit = gap_limit(max_gap)
    rows = segments.select(*keys, "seg_id", "pos", "id", "start_s", "end_s", "text", "words")
    flags = [StructField(n, BooleanType()) for n in ("changed", "clamped", "split", "capped")]
    schema = StructType([*rows.schema.fields[:-1], StructField("words", ArrayType(WORD)), *flags, StructField("pieces", ArrayType(PIECE))])

    def batch(*columns: list) -> dict:
        out = dict(zip(rows_names, columns))
        made = [repair(a, b, w, limit, longest) for a, b, w in zip(out["start_s"], out["end_s"], out["words"])]
        for i, n in enumerate(("changed", "clamped", "split", "capped", "pieces")):
            out[n] = [m[i] for m in made]
        out["words"] = [None if w is None else [{"word": x.get("word"), "start": x.get("start_s", x.get("start")), "end": x.get("end_s", x.get("end")), "probability": x.get("probability")} if x else None for x in w] for w in out["words"]]
        return out

    rows_names = rows.columns
    by = Window.partitionBy(*keys).orderBy("pos", "seg_id")
    mapped = map_columns(rows, batch, schema)
    mapped = mapped.withColumn("sticky", F.max("changed").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("any", F.max("changed").over(Window.partitionBy(*keys)))
    worded = F.col("pieces")[0]["words"].isNotNull()
    same = F.array(F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", "words"))
    kept = F.array(F.struct(F.col("pieces")[0]["start"].alias("start"), F.col("pieces")[0]["end"].alias("end"), "text", "words"))
    chosen = F.when(worded & F.col("sticky"), F.col("pieces")).when(F.col("capped"), kept).otherwise(same)
    out = mapped.select(*keys, "seg_id", "pos", "id", "any", "clamped", "split", "capped", F.posexplode(chosen).alias("part", "p"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "seg_id", "part")) - 1
    out = out.withColumn("id", F.when(F.col("any"), number.cast("bigint")).otherwise(F.col("id")))
    return out.select(*keys, "seg_id", "id", F.col("p.start").alias("start_s"), F.col("p.end").alias("end_s"), "p.text", "p.words", "clamped", "split", "capped")


def imagined(text: str, start: float, end: float, spaceless: bool) -> list[dict]:
    """Words of a text without word times, spread evenly over its time by their lengths."""
    units = [c for c in text if c.strip()] if spaceless else re.findall(r"\s*\S+", text)
    total, span, out, done = sum(map(len, units)), max(0.0, end - start), [], 0
    for u in units:
        a, done = done, done + len(u)
        out.append({"word": u, "start": round(start + span * a / total, 3), "end": round(start + span * done / total, 3), "probability": None})
    return out


def is_spaceless(text: str, language: str | None) -> bool:
    """Whether a text is written without spaces: by its language, or by its characters if that is not known."""
    return language.lower() in SPACELESS if language else bool(_cjk.search(text))


def imagined_words(segments: DataFrame) -> DataFrame:
    """(seg_id, n, word, start_ms, end_ms): the imagined words of segments (with ``lang``) that have no usable word of their own."""
    real = F.exists("words", lambda w: (squeeze(w["word"]) != "") & w["start_s"].isNotNull() & w["end_s"].isNotNull())
    rows = segments.where(~F.coalesce(real, F.lit(False))).select("seg_id", "text", "start_s", "end_s", "lang")
    schema = StructType([rows.schema["seg_id"], StructField("units", ArrayType(WORD))])

    def batch(ids: list, texts: list, starts: list, ends: list, langs: list) -> dict:
        starts = [a or 0.0 for a in starts]
        ends = [a if b is None else b for a, b in zip(starts, ends)]
        made = [imagined(t, a, b, is_spaceless(t, g)) if t.strip() else [] for t, a, b, g in zip(texts, starts, ends, langs)]
        return {"seg_id": ids, "units": made}

    out = map_columns(rows, batch, schema).select("seg_id", F.posexplode("units").alias("n", "w"))
    at = (F.round(F.col(f"w.{k}") * 1000).cast("bigint").alias(f"{k}_ms") for k in ("start", "end"))
    return out.select("seg_id", F.col("n").cast("bigint").alias("n"), "w.word", *at)


def ends_sentence(text: str) -> bool:
    bare = text.rstrip().rstrip(CLOSERS)
    return bare[-1:] != "" and bare[-1] in ENDS


def laid_out(text: str | None, start: float | None, end: float | None, words: list | None, language: str | None, width: int, lines: int, sentences: bool, max_gap: float | None) -> list[dict]:
    """The cues that one segment is laid out to; none if it has neither words nor text."""
    body = text or ""
    spaceless = is_spaceless(body, language)
    a = start or 0.0
    stream = usable(words) or (imagined(body, a, a if end is None else end, spaceless) if body.strip() else [])
    groups, group = [], []
    for k, w in enumerate(stream):
        group.append(w)
        pause = max_gap is not None and k + 1 < len(stream) and stream[k + 1]["start"] - w["end"] > max_gap
        if sentences and (pause or ends_sentence(shown(group))):
            groups.append(group)
            group = []
    out = []
    for g in [*groups, group]:
        rows: list[list[dict]] = []
        for w in g:
            lead = w["word"].strip()[:1]
            if rows and (len(shown([*rows[-1], w])) <= width or (lead and lead in NO_START)):
                rows[-1].append(w)
            else:
                rows.append([w])
        for k in range(0, len(rows), lines):
            part = rows[k : k + lines]
            shown_lines = [t for t in map(shown, part) if t]
            if shown_lines:
                cue = piece([w for r in part for w in r], "\n".join(shown_lines))
                out.append(cue if words else cue | {"words": None})
    return out


def formatted(segments: DataFrame, keys: list[str], width: int = 1000, lines: int = 1, sentences: bool = False, max_gap: object = None, language: str | None = None) -> DataFrame:
    """(keys, seg_id, id, start_s, end_s, text, words): segments laid out as cues, numbered from 0 in every recording.

    Nothing happens unless sentences are parted, the width is under 1000 or there is more than one line. A column
    ``lang`` of the segments overrides ``language`` where it is not null. Segments with neither words nor text stay as they are.
    """
    columns = [*keys, "seg_id", "pos", "start_s", "end_s", "text", "words"]
    tongue = F.coalesce("lang", F.lit(language)) if "lang" in segments.columns else F.lit(language).cast("string")
    rows = segments.select(*columns, tongue.alias("lang"))
    if not (sentences or width < 1000 or lines > 1):
        return segments.select(*keys, "seg_id", "id", "start_s", "end_s", "text", "words")
    limit = gap_limit(max_gap)
    schema = StructType([*(rows.schema[c] for c in [*keys, "seg_id", "pos"]), StructField("pieces", ArrayType(PIECE))])

    def batch(*values: list) -> dict:
        c = dict(zip([*columns, "lang"], values))
        made = []
        for a, b, t, w, lang in zip(c["start_s"], c["end_s"], c["text"], c["words"], c["lang"]):
            cues = laid_out(t, a, b, w, lang, max(1, width), max(1, lines), sentences, limit)
            made.append(cues or [{"start": a, "end": b, "text": t, "words": None}])
        return {n: c[n] for n in [*keys, "seg_id", "pos"]} | {"pieces": made}

    out = map_columns(rows, batch, schema).select(*keys, "seg_id", "pos", F.posexplode("pieces").alias("part", "p"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "seg_id", "part")) - 1
    return out.select(*keys, "seg_id", number.cast("bigint").alias("id"), F.col("p.start").alias("start_s"), F.col("p.end").alias("end_s"), "p.text", "p.words")
