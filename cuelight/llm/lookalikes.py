"""One consistent form for texts that look the same (problem 3).

Widths, combining marks, spaces and invisible characters are folded for whole Arrow batches at once. Look-alike letters
are repaired by script: the dominant script of a token is that of its letters that have no twin in the other script; the
twins in such a mixed token are put into it, but only if the word that results exists in the corpus, unmixed. A token
of twins alone is mixed with the text that it stands in, if that is dominated by another script; a text of such tokens only
stays as it is. The vocabulary is never held in one place: the words that
repairs would give are joined with the words of the corpus.

Defined results: a null text stays null; a text of nothing but space and invisible characters becomes empty; repeated rows
give one row; characters that are seen to differ (case, punctuation, superscripts, circled and fraction forms, the number of
spaces, line breaks) stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from cuelight.functions.batches import map_columns
from cuelight.session import cut

#: Cyrillic and Greek letters and the Latin letters that look the same in common type; letters that are
#: seen to differ (a Greek alpha, a Cyrillic ve in small) are none.
TO_LATIN = dict(zip("аеосрухіјѕһԁԛԝӏүАВЕКМНОРСТХІЅЈУҮӀԚԜҺ", "aeocpyxijshdqwlyABEKMHOPCTXISJYYIQWH")) | dict(zip("ονιϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ", "ovicjABEZHIKMNOPTYXCJ"))
del TO_LATIN["ι"], TO_LATIN["Ͽ"]  # an iota has no dot, and the last one is turned
#: Kanji, kana and dashes and the katakana that look the same.
TO_KATAKANA = dict(zip("口力夕卜二工八一―りへべぺ", "ロカタトニエハーーリヘベペ"))
#: Characters without a shape of their own.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0001-\U000e007f\U000e0100-\U000e01ef"

#: Rows of one lot of a class that looks the same.
LOT = 1_000

_invisible = re.compile(f"[{INVISIBLE}]+")
_space = re.compile("[    -   　]")
_dash = re.compile("[‐‑−]")
#: Blocks with characters whose compatibility form is seen to differ from them.
_blocks = re.compile("([ª²³¹º¼-¾ʰ-˿ᴀ-ᶿ⁰-₟℀-⅏⅐-↏①-⓿㆐-㆟㈀-㏿ꟲ-ꟹꭜ-ꭟ\U0001d400-\U0001d7ff\U0001f100-\U0001f2ff])")
_differ = ("<circle>", "<super>", "<sub>", "<fraction>", "<square>", "<font>")
_letters = "A-Za-zªµºÀ-ÖØ-öø-ɏḀ-ỿ"
_other = "Ͱ-ϿЀ-ԯ"
_elsewhere = re.compile("[ぁ-ヿ一-鿿가-힣฀-๿ऀ-ॿ]")
_twins = "".join(TO_KATAKANA)
_latin_word = re.compile(f"[{_letters}{_other}]+")
_kana_word = re.compile(f"[ァ-ヺー{_twins}]+")
_clean = re.compile(f"[{_letters}]+|[ァ-ヺー]+|[Ѐ-ԯ]+|[Ͱ-Ͽ]+")
_latin_twin = set(TO_LATIN.values())
_from_latin = {v: k for k, v in TO_LATIN.items() if "Ѐ" <= k <= "ԯ"}
#: Java's pattern of the rows that may hold a mixed token; all others need no repair.
SUSPECT = f"[{_other}]|[ァ-ヺーｦ-ﾟ゙゚][{INVISIBLE}]*[{_twins}]|[{_twins}][゙゚{INVISIBLE}]*[ァ-ヺーｦ-ﾟ]"
_suspect = re.compile(SUSPECT)


def fold(text: str) -> str:
    """Width, combining marks, spaces and invisible characters brought to one form."""
    if text.isascii():
        return text
    text = _space.sub(" ", _invisible.sub("", text))
    if _blocks.search(text):
        parts = _blocks.split(text)
        keep = [i % 2 and unicodedata.decomposition(p).startswith(_differ) for i, p in enumerate(parts)]
        text = unicodedata.normalize("NFC", "".join(p if k else unicodedata.normalize("NFKC", p) for p, k in zip(parts, keep)))
    else:
        text = unicodedata.normalize("NFKC", text)
    return _dash.sub("-", text)


def fold_all(texts: list[str]) -> list[str]:
    """``fold`` of every text, in one call; NUL, which cannot be seen, parts them."""
    joined = "\0".join(texts)
    if joined.count("\0") != len(texts) - 1:
        return [fold(t.replace("\0", "")) for t in texts]
    return fold(joined).split("\0") if texts else []


def repairs(folded: str) -> Iterator[tuple[int, int, list[tuple[int, int, str]]]]:
    """The mixed tokens of a folded text: start, end and the repairs to try, best first, as (start, end, word)."""
    if re.search(f"[{_other}]", folded):
        plain = sum(c not in _latin_twin for w in re.findall(f"[{_letters}]+", folded) for c in w)
        other = sum(c not in TO_LATIN for w in re.findall(f"[{_other}]+", folded) for c in w)
        elsewhere = _elsewhere.search(folded)
        for m in _latin_word.finditer(folded):
            w = m.group()
            if _clean.fullmatch(w) and re.fullmatch(f"[{_letters}]+", w):
                continue
            latin = sum(c not in _latin_twin and c not in TO_LATIN and not "Ͱ" <= c <= "ԯ" for c in w)
            strange = sum("Ͱ" <= c <= "ԯ" and c not in TO_LATIN for c in w)
            mixed = len({"l" if c < "Ͱ" or c >= "Ḁ" else "g" if c < "Ѐ" else "c" for c in w}) > 1
            if strange == 0 and (latin or mixed or plain > other or (elsewhere and other == plain == 0)):
                yield m.start(), m.end(), [(m.start(), m.end(), "".join(TO_LATIN.get(c, c) for c in w))]
            elif strange and not latin and re.search(f"[{_letters}]", w):
                yield m.start(), m.end(), [(m.start(), m.end(), "".join(_from_latin.get(c, c) for c in w))]
    for m in _kana_word.finditer(folded):
        w = m.group()
        if not re.search(f"[{_twins}]", w) or not re.search("[ァ-ヺ]", w):
            continue
        lead, tail = len(w) - len(w.lstrip(_twins)), len(w) - len(w.rstrip(_twins))
        tries = []
        for a in range(lead + 1):  # twins at the edges may be words of their own script
            for b in range(tail + 1):
                part = w[a : len(w) - b]
                if re.search(f"[{_twins}]", part):
                    tries.append((m.start() + a, m.end() - b, "".join(TO_KATAKANA.get(c, c) for c in part)))
        tries.sort(key=lambda x: x[0] - x[1])
        yield m.start(), m.end(), tries


def repair(folded: str, words: set[str]) -> str:
    """The folded text with each mixed token repaired whose repair is one of ``words``."""
    out, at = [], 0
    for _, _, tries in sorted(repairs(folded)):
        for a, b, word in tries:
            if word in words:
                out += [folded[at:a], word]
                at = b
                break
    return "".join([*out, folded[at:]])


def digest(text: str) -> bytes:
    """16 bytes that stand for a text."""
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()


def canonical(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, ``text``, ``canonical``): each distinct row and the one consistent form of its text.

    ``texts`` is the whole corpus: its words are the vocabulary of the repairs.
    """
    return _canonical(texts, keys, text_col).distinct()


def _canonical(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``canonical``, repeated rows as often as they are there."""
    rows = texts.select(*(texts[k] for k in keys), texts[text_col].alias("text"))
    key_fields = [rows.schema[k] for k in keys]
    seen = F.col("text").rlike(SUSPECT)

    def words_of(column: list) -> dict:
        folded = fold_all([t for t in set(column) if t])
        clean = {w for w in _clean.findall("\0".join(folded))}
        wanted = {word for f in folded if _suspect.search(f) for _, _, tries in repairs(f) for _, _, word in tries}
        words = [*clean, *(wanted - clean), *(wanted & clean)]
        return {"word": words, "wanted": [0] * len(clean) + [1] * (len(words) - len(clean))}

    from pyspark.sql.types import IntegerType

    word_rows = map_columns(rows.where("text is not null").select("text"), words_of, StructType([StructField("word", StringType()), StructField("wanted", IntegerType())]))
    known = word_rows.groupBy("word").agg(F.min("wanted").alias("lo"), F.max("wanted").alias("hi")).where("lo = 0 and hi = 1").select("word")

    def fold_batch(*columns: list) -> dict:
        full = [t or "" for t in columns[-1]]
        folded = [None if t is None else f for t, f in zip(columns[-1], fold_all(full))]
        return dict(zip(keys, columns)) | {"text": columns[-1], "canonical": [f and f.strip() for f in folded]}

    out_schema = StructType([*key_fields, StructField("text", StringType()), StructField("canonical", StringType())])
    plain = map_columns(rows.where(~F.coalesce(seen, F.lit(False))), fold_batch, out_schema)

    def try_batch(*columns: list) -> dict:
        out = fold_batch(*columns)
        return out | {"tries": [[w for _, _, tries in repairs(f) for _, _, w in tries] for f in out["canonical"]]}

    tried = map_columns(rows.where(seen), try_batch, StructType([*out_schema.fields, StructField("tries", ArrayType(StringType()))]))
    whole = [*keys, "text", "canonical"]
    tried = tried.select(*whole, F.explode_outer("tries").alias("word")).join(known.withColumn("hit", F.col("word")), "word", "left")
    tried = tried.groupBy(*whole).agg(F.collect_set("hit").alias("hits"))

    def repair_batch(*columns: list) -> dict:
        fixed = [repair(f, set(h)) if h else f for f, h in zip(columns[-2], columns[-1])]
        return dict(zip([*keys, "text"], columns)) | {"canonical": fixed}

    return plain.unionByName(map_columns(tried, repair_batch, out_schema))


def spellings(texts: DataFrame, group: list[str], id_col: str, text_col: str = "text") -> DataFrame:
    """(group, ``id_col``, ``look``, ``raw``): digests of the form and of the characters of every text that is not blank."""
    rows = _canonical(texts, [*group, id_col], text_col)
    fields = [rows.schema[k] for k in (*group, id_col)]
    schema = StructType([*fields, StructField("look", BinaryType()), StructField("raw", BinaryType())])

    def digests(*columns: list) -> dict:
        *keys, text, form = columns
        keep = [i for i, f in enumerate(form) if f]
        out = {n: [c[i] for i in keep] for n, c in zip([*group, id_col], keys)}
        return out | {"look": [digest(form[i]) for i in keep], "raw": [digest(text[i].strip()) for i in keep]}

    return map_columns(rows, digests, schema)


def look_classes(texts: DataFrame, group: list[str], id_col: str, text_col: str = "text") -> DataFrame:
    """(group, ``id_col``, ``class_id``, ``spelling_id``): every text's class of one look and its spelling in it, each named by
    its smallest id. Copies and pairs are not expanded; a class is one if it has one ``class_id``, and rows of it with another
    ``spelling_id`` are written with other characters. Rows with a null in the group's columns are in no class."""
    rows = cut(spellings(texts, group, id_col, text_col).dropna(subset=group).distinct())
    own = rows.groupBy(*group, "look", "raw").agg(F.min(id_col).alias("spelling_id"))
    classes = own.groupBy(*group, "look").agg(F.min("spelling_id").alias("class_id"))
    named = own.join(classes, [*group, "look"])
    return rows.join(named, [*group, "look", "raw"]).select(*group, id_col, "class_id", "spelling_id")


def same_look(texts: DataFrame, group: list[str], id_col: str, text_col: str = "text") -> DataFrame:
    """(group, ``id_a``, ``id_b``): pairs of rows of a group whose texts look the same and are not the same characters.

    Rows are first gathered into classes of one spelling; only groups with two spellings or more are joined, each row of a
    spelling that is not its group's most frequent one with the rows of the other spellings, so groups of copies cost
    nothing and every row that is joined is in a pair. Large classes are salted: their rows are spread in lots of ``LOT``, to
    each of which the rows of unusual spellings go. ``look_classes`` gives the same without any pair. Rows with a null in the
    group's columns are in no group.
    """
    rows = cut(spellings(texts, group, id_col, text_col))
    look = [*group, "look"]
    spelt = rows.groupBy(*look, "raw").agg(F.count("*").alias("n"))
    varied = spelt.groupBy(*look).agg(F.max_by("raw", F.struct("n", "raw")).alias("usual"), F.count("*").alias("spellings"), F.sum("n").alias("n"))
    varied = varied.where("spellings > 1").select(*look, "usual", F.ceil(F.col("n") / LOT).cast("int").alias("lots"))
    rows = rows.join(varied, look)
    lot = F.pmod(F.xxhash64(id_col), F.col("lots")).cast("int")
    a = rows.select(*look, lot.alias("lot"), F.col(id_col).alias("a"), F.col("raw").alias("raw_a"), F.expr("raw = usual").alias("usual_a"))
    b = rows.where("raw <> usual").select(*look, F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.col(id_col).alias("b"), F.col("raw").alias("raw_b"))
    pairs = a.join(b, [*look, "lot"]).where("raw_a <> raw_b and a <> b and (usual_a or a < b)")
    return pairs.select(*group, F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
