"""Captions into clean speaker turns (problem 6).

An automaton holds the annotations of sounds and the fillers; what it finds in a line, and the times,
glyphs, tags and music marks, are intervals that are subtracted from the line. Context decides what a match, a bracket or a
colon means: a bracket where a line begins (after times, markers and sounds) is a label if the survey knows it or it is no
sentence, unless it is a sound; what stands before a colon is one if the survey knows it or it is of three words at most, unless a
digit stands before the colon; a filler is one where a pause follows. A line asks the survey one thing at most, so it is read for
both answers and what it asks is joined with all labels of the survey. Spellings of a label are one speaker if they are equal without case, width, invisible characters,
look-alikes and a suffix for a voice that is off; a label in kana is the name whose reading the ruby gives. Windows carry the speaker
on over the cues of a reel, in blocks of time.

Defined results: cues of null start or null or blank text say nothing; a cue delivered twice counts once; speech before the first
label of a reel has no speaker and begins no turn; a speaker without any key in the survey is named as spelled most often;
fillers are spoken words, but are no part of the clean text. Equal starts are taken by cue_id.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from cuelight.functions.batches import map_columns
from cuelight.llm.lookalikes import TO_KATAKANA, TO_LATIN, fold, fold_all
from cuelight.operators.ordered import last_known
from cuelight.session import cut

#: Seconds of one block of a reel's time.
BLOCK_S = 3600

#: Annotations of sounds, as guidelines for captions of several languages name them; a Japanese one may stand at
#: the end of a longer one.
SOUNDS = (
    "音 拍手 笑 笑い 笑い声 爆笑 歓声 悲鳴 叫び声 泣き 泣き声 すすり泣き 鳴き声 吠える声 ため息 咳 せき 咳払い くしゃみ いびき 口笛 雷鳴 銃声 足音 物音 着信音 効果音 どよめき ざわめき チャイム サイレン ブザー BGM 音楽 無音"
    " laugh laughs laughing laughter chuckle chuckles chuckling giggles giggling snickers cough coughs coughing sneezes sniffles sigh sighs sighing gasp gasps gasping groans moans grunts panting"
    " cry cries crying sob sobs sobbing scream screams screaming shouting yelling whisper whispers whispering mumbling murmuring humming singing whistling snoring applause clapping cheer cheers cheering booing"
    " music thunder rumbling rain wind door doors opens closes creak creaks creaking slam slams slamming knock knocks knocking footsteps phone telephone ring rings ringing beep beeps beeping buzz buzzes buzzing"
    " bell bells siren sirens gunshot gunshots explosion barking barks meows engine silence static inaudible indistinct unintelligible chatter crosstalk"
    " lachen lacht gelächter applaus jubel musik donner seufzt seufzen husten hustet schreie schluchzen schritte klopfen klingeln unverständlich"
    " rire rires applaudissements musique tonnerre soupir soupirs soupire toux cris sanglots sonnerie inaudible risa risas aplausos música trueno suspiro suspiros suspira tos gritos sollozos pasos inaudible"
    " 笑声 掌声 音乐 叹气 叹息 脚步声 哭声 哭泣 欢呼声 咳嗽 咳嗽声 雷声 铃声 敲门声 尖叫声 웃음 웃음소리 박수 박수소리 음악 한숨 기침 천둥 천둥소리 발소리 비명 환호 환호성 울음 เสียงหัวเราะ เสียงปรบมือ เสียงดนตรี हँसी तालियाँ संगीत"
).split()
#: Words that only fill a pause, where a pause follows them.
FILLERS = (
    "えっと|えーっと|えーと|ええと|えと|うーんと|うーん|うん|まあ|まあその|あの|あのー|あのう|その|そのー|ええ|なんか|ほら|um|umm|uh|er|erm|ah|hmm|well|like|you know|i mean|嗯|呃|那个|这个|음|어|그|저기|euh|ben|bah|äh|ähm|hm|eh|este|pues|เอ่อ|อืม|अं"
).split("|")

_time = re.compile(r"[(\[]?\s*\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?\s*(?:-->\s*\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?\s*)?[)\]]?")
_marker = re.compile("[-–—≫»・●➡⇒→-]+|>>+")
_tag = re.compile("</?[A-Za-z]+>")
_star = re.compile(r"\*[^*\n]+\*")
_bracket = re.compile(r"[(\[【<〈《〔]\s*([^()\[\]【】<>〈〉《》〔〕\n]+?)\s*[)\]】>〉》〕]")
_colon = re.compile(r"([^\s:()\[\]【】<>「」『』“”«»„\"。、,.!?…｡][^:()\[\]【】<>「」『』“”«»„\"。、,!?…｡\n]*?)\s*:(?!//)")
_notes = re.compile("[♪♬♩♫][^♪♬♩♫\n]*[♪♬♩♫]|[♪♬♩♫]\\s*[~〜～]*|[-➡]")
_voice = re.compile(r"(?:・心の声|の心の声|の声|\(声\)|・声|'s voice| \(v\.?o\.?\))$")
_word = re.compile(r"\w")
#: Characters of which times, tags, notes, markers, brackets and labels have one at least.
_special = re.compile(r"[:()\[\]<>*♪♬♩♫➡⇒→≫»・●–—【】〈〉《》〔〕-]")
_pause = re.compile(r"\s*(?:[、,，…‥—–]|\.{2,})+\s*|$")
_twins = re.compile("[" + "".join(TO_LATIN) + "]")


@lru_cache(maxsize=1)
def automaton():
    """Sounds and fillers, folded and in lower case, as {kind: length}; one a worker."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("sound", SOUNDS), ("filler", FILLERS)):
        for w in map(surveyed_as, words):
            a.add_word(w, {**a.get(w, {}), kind: len(w)})
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    """In lower case and with look-alikes as Latin letters, character by character."""
    low = text.lower()
    low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low if low.isascii() else _twins.sub(lambda m: TO_LATIN[m.group()].lower(), low)


def surveyed_as(label: str) -> str:
    """A label as the survey is asked for it: folded, in lower case, without outer white space."""
    return _lower(fold(label).strip())


def matches(line: str) -> dict[str, list[tuple[int, int]]]:
    """The places of what the automaton finds in a folded line, by kind."""
    out: dict[str, list[tuple[int, int]]] = {"sound": [], "filler": []}
    for end, kinds in automaton().iter(_lower(line)):
        for kind, size in kinds.items():
            out[kind].append((end + 1 - size, end + 1))
    return out


def _is_sound(line: str, begin: int, end: int, sounds: list[tuple[int, int]]) -> bool:
    """Whether what stands at a place is a sound: a sound ends it, or is one of its words."""
    for a, b in sounds:
        if begin <= a and b <= end:
            if b == end and (a == begin or not line[a].isascii()):
                return True
            if line[a].isascii() and not (a > begin and line[a - 1].isalpha()) and not (b < end and line[b].isalpha()):
                return True
    return False


@lru_cache(maxsize=100_000)
def speaker_id(label: str) -> str:
    """What all spellings of one label have in common."""
    s = re.sub(r"\s+", " ", fold(label)).strip()
    if not s.isascii():
        s = "".join(TO_LATIN.get(c, c) for c in s)
        bare = _voice.sub("", s)
        if re.search("[ァ-ヺ]", bare) or all(c in TO_KATAKANA for c in bare):
            s = "".join(TO_KATAKANA.get(c, c) for c in bare)
    s = s.casefold()
    return _voice.sub("", s).strip(" ・:-")


def read_line(line: str, labels: tuple = (), clean: bool = True) -> tuple[str | None, bool, str]:
    """Of a folded line: its label, whether it has speech, and (if ``clean``) its clean text; ``labels`` are known ones, as ``surveyed_as``."""
    *read, asked = read_for(line, False, clean)
    return tuple(read_for(line, True, clean)[:3] if asked is not None and asked in labels else read)


def read_for(line: str, known: bool, clean: bool = True) -> tuple[str | None, bool, str, str | None]:
    """``read_line`` if what it asks the survey for is ``known`` there or not, and what that is. It asks once at most: the
    answer is a label, behind which there is no other, or ends the search."""
    at, label, n, asked = 0, None, len(line), None
    special = _special.search(line)
    if not special and not clean:  # nothing but words
        return None, bool(_word.search(line)), "", None
    found = matches(line)
    sounds = found["sound"]
    while special and at < n:
        if line[at].isspace():
            at += 1
            continue
        m = _time.match(line, at) or _tag.match(line, at) or _star.match(line, at) or _marker.match(line, at)
        if m:
            at = m.end()
            continue
        m = _bracket.match(line, at)
        if m:
            heard = _is_sound(line, *m.span(1), sounds)
            if label is None or heard:
                if not heard:
                    # what the survey knows is a label, whatever it looks like; else it must be a name
                    if not re.search(r"[^\W\d]", m.group(1)):
                        break
                    if re.search("[。!?…]", m.group(1)):
                        asked = _lower(line)[slice(*m.span(1))]
                        if not known:
                            break
                    label = m.group(1)
                at = m.end()
                if label is not None and line[at : at + 1] == ":":
                    at += 1
                continue
        m = _colon.match(line, at) if label is None else None
        if m and not m.group(1)[-1].isdigit() and re.search(r"[^\W\d]", m.group(1)):
            if m.group(1).count(" ") >= 3:
                asked = _lower(line)[slice(*m.span(1))]
                if not known:
                    break
            label = m.group(1)
            at = m.end()
            continue
        break
    rest, cuts = line[at:], []
    if _special.search(rest):
        cuts += [m.span() for p in (_time, _tag, _star, _notes) for m in p.finditer(rest)]
        cuts += [m.span() for m in _bracket.finditer(rest) if _is_sound(line, m.start(1) + at, m.end(1) + at, sounds)]
    spoken = bool(_word.search(_subtract(rest, cuts)))
    if not spoken or not clean:
        return label, spoken, "", asked
    for a, b in found["filler"]:
        # a filler stands between a beginning or a mark and a pause
        pause = _pause.match(line, b)
        if a >= at and pause and not _word.search(line[max(0, a - 1) : a]):
            cuts.append((a - at, pause.end() - at))
    return label, True, re.sub(r"\s+", " ", _subtract(rest, cuts)).strip(), asked


def _subtract(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the intervals."""
    out, at = [], 0
    for a, b in sorted(cuts):
        out.append(text[at:a] if a > at else "")
        at = max(at, b)
    return "".join([*out, text[at:]])


def lines(cues: DataFrame, clean: bool = True) -> DataFrame:
    """(cue_id, stem, reel, start_s, end_s, lines, readings): every cue once with its lines, cleaned (line_no, label, id, spoken,
    text); what a line asks the survey for (``asked``), and what it is if that is a label there (``if_known``)."""
    rows = cues.select("cue_id", "stem", "reel", "start_s", "end_s", "text", "ruby").where("start_s is not null and text is not null").dropDuplicates(["cue_id"])
    names = ["cue_id", "stem", "reel", "start_s", "end_s"]
    read = [StructField("label", StringType()), StructField("id", StringType()), StructField("spoken", BooleanType()), StructField("text", StringType())]
    item = StructType([StructField("line_no", LongType()), *read, StructField("asked", StringType()), StructField("if_known", StructType(read))])
    schema = StructType([*(rows.schema[n] for n in names), StructField("lines", ArrayType(item)), StructField("readings", ArrayType(StringType()))])

    def one(label: str | None, spoken: bool, said: str) -> dict:
        return {"label": label, "id": label and speaker_id(label), "spoken": spoken, "text": said}

    def batch(*columns: list) -> dict:
        out = dict(zip(names, columns))
        every = []
        for text in fold_all(columns[5]):
            own = []
            for k, line in enumerate(text.split("\n")):
                *got, asked = read_for(line, False, clean)
                if got[0] is not None or got[1] or asked is not None:
                    own.append({"line_no": k + 1, **one(*got), "asked": asked, "if_known": asked and one(*read_for(line, True, clean)[:3])})
            every.append(own)
        return out | {"lines": every, "readings": [[speaker_id(r) for r in ruby or [] if r] for ruby in columns[6]]}

    return map_columns(rows, batch, schema)


def answered(rows: DataFrame, surveyed: DataFrame, read: list[str]) -> DataFrame:
    """The rows of lines with what they are (``read``) by all labels of the survey: only lines that ask it for one are joined."""
    others = [c for c in rows.columns if c not in (*read, "asked", "if_known")]
    asking = rows.where("asked is not null").join(surveyed.select(F.col("key_as").alias("asked"), F.lit(True).alias("there")).distinct(), "asked", "left")
    asking = cut(asking.select(*others, *(F.when(F.col("there"), F.col(f"if_known.{c}")).otherwise(F.col(c)).alias(c) for c in read)))
    return rows.where("asked is null").select(*others, *read).unionByName(asking.where("label is not null or spoken"))


def survey_keys(cue_stats: DataFrame) -> DataFrame:
    """(stem, reel, key, n, id, key_as): the labels of the survey with the speaker of each spelling, and as lines ask for it."""
    rows = cue_stats.select("stem", "reel", F.explode("speakers").alias("key", "n")).groupBy("stem", "reel", "key").agg(F.max("n").alias("n"))
    schema = StructType([*rows.schema.fields, StructField("id", StringType()), StructField("key_as", StringType())])
    return map_columns(rows, lambda stem, reel, key, n: {"stem": stem, "reel": reel, "key": key, "n": n, "id": [speaker_id(k or "") for k in key], "key_as": [surveyed_as(k or "") for k in key]}, schema)


def _speakers(rows: DataFrame, keys: list[str], block: str, order: list[str]) -> DataFrame:
    """The spoken rows with ``who``, the last ``id`` at or before each, and ``before``, that of the spoken row before it.

    Both come from one window within a block; between blocks one row a block is carried on.
    """
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.last("id", ignorenulls=True).over(upto))
    rows = rows.withColumn("__prev", F.last(F.when(F.col("spoken"), F.struct(F.col("__own").alias("v"))), ignorenulls=True).over(before))
    at = f"struct({', '.join(order)})"
    ends = rows.groupBy(*keys, block).agg(F.expr(f"max_by(id, {at}) filter (where id is not null)").alias("__label"), F.expr(f"max_by(struct(__own as v), {at}) filter (where spoken)").alias("__said"))
    across = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__from", F.last("__label", ignorenulls=True).over(across))
    ends = ends.withColumn("__said", F.expr("case when __said is not null then coalesce(__said.v, __from) end"))
    ends = ends.withColumn("__before", F.last("__said", ignorenulls=True).over(across)).where("__from is not null").select(*keys, block, "__from", "__before")
    rows = rows.join(ends, [*keys, block], "left").withColumn("who", F.coalesce("__own", "__from"))
    rows = rows.withColumn("before", F.expr("case when __prev is null then __before else coalesce(__prev.v, __from) end"))
    return rows.where("spoken and who is not null").drop("id", "spoken", "__own", "__prev", "__from", "__before")


def spoken_lines(cues: DataFrame, cue_stats: DataFrame, text: bool = False) -> DataFrame:
    """The spoken lines with their speaker (``who``) and the speaker before (``before``), both an id, and the speaker's name;
    with their clean text, if wanted. What is read again is written to the checkpoint folder, so nothing is computed twice."""
    names = ["stem", "reel", "cue_id", "start_s"]
    read = ["label", "id", "spoken", *(["text"] if text else [])]
    rows = lines(cues, text).select(*names, F.explode("lines").alias("x"), "readings")
    has_label = F.col("x.id").isNotNull() | F.col("x.asked").isNotNull()
    rows = cut(rows.select(*names, "x.line_no", *(f"x.{c}" for c in read), "x.asked", "x.if_known", F.when(has_label, F.col("readings")).alias("readings")))
    surveyed = cut(survey_keys(cue_stats))
    rows = answered(rows, surveyed, read)
    # a reading is the name of the label that it stands with most often, in the reel, else in the whole corpus
    pairs = rows.where("id is not null").select("stem", "reel", "id", F.explode(F.array_distinct("readings")).alias("reading")).where("id <> reading").groupBy("stem", "reel", "reading", "id").agg(F.count("*").alias("n"))
    kana = rows.where("id rlike '^[ぁ-ゖー]+$'").select("stem", "reel", F.col("id").alias("reading")).distinct()
    kana = kana.unionByName(surveyed.where("id rlike '^[ぁ-ゖー]+$'").select("stem", "reel", F.col("id").alias("reading"))).distinct()
    best = F.max_by("id", F.struct("n", "id"))
    here = pairs.groupBy("stem", "reel", "reading").agg(best.alias("here"))
    anywhere = pairs.groupBy("reading", "id").agg(F.sum("n").alias("n")).groupBy("reading").agg(best.alias("anywhere"), F.sum("n").alias("all"), F.max("n").alias("most")).where("2 * most > all")
    named = kana.join(here, ["stem", "reel", "reading"], "left").join(anywhere, "reading", "left").select("stem", "reel", F.col("reading").alias("id"), F.coalesce("here", "anywhere").alias("name")).where("name is not null")
    named = cut(named)
    rows = rows.drop("readings").join(named, ["stem", "reel", "id"], "left").withColumn("id", F.coalesce("name", "id")).drop("name")
    rows = rows.withColumn("block", F.expr(f"floor(start_s / {BLOCK_S})"))
    rows = cut(_speakers(rows, ["stem", "reel"], "block", ["start_s", "cue_id", "line_no"]))
    # of all spellings of a speaker, the key that counts most in the survey
    keys = surveyed.join(named, ["stem", "reel", "id"], "left").withColumn("id", F.coalesce("name", "id"))
    keys = keys.groupBy("stem", "reel", F.col("id").alias("who")).agg(F.min_by("key", F.struct(-F.col("n"), "key")).alias("speaker"))
    spelt = rows.where("label is not null").groupBy("stem", "reel", "who", "label").agg(F.count("*").alias("n"))
    spelt = spelt.groupBy("stem", "reel", "who").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("spelt"))
    rows = rows.join(keys, ["stem", "reel", "who"], "left").join(spelt, ["stem", "reel", "who"], "left")
    return rows.withColumn("speaker", F.coalesce("speaker", "spelt", "who")).drop("spelt")


def turn_starts(cues: DataFrame, cue_stats: DataFrame) -> DataFrame:
    """(``cue_id``, ``line_no``, ``speaker``): one row where each turn begins."""
    return spoken_lines(cues, cue_stats).where("not (before <=> who)").select("cue_id", "line_no", "speaker")


def turns(cues: DataFrame, cue_stats: DataFrame) -> DataFrame:
    """(stem, reel, cue_id, line_no, speaker, start_s, text): the turns, each with its clean text, named by where it begins."""
    rows = spoken_lines(cues, cue_stats, text=True).withColumn("first", F.expr("case when not (before <=> who) then named_struct('s', start_s, 'c', cue_id, 'l', line_no) end"))
    rows = last_known(cut(rows), ["stem", "reel"], "block", ["start_s", "cue_id", "line_no"], F.col("first"), "turn")
    parts = F.array_sort(F.collect_list(F.struct("start_s", "cue_id", "line_no", "text")))
    rows = rows.groupBy("stem", "reel", "turn", "speaker").agg(parts.alias("parts"))
    return rows.select("stem", "reel", F.col("turn.c").alias("cue_id"), F.col("turn.l").alias("line_no"), "speaker", F.col("turn.s").alias("start_s"), F.expr("array_join(filter(transform(parts, p -> p.text), t -> t <> ''), ' ')").alias("text"))
