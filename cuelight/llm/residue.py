"""Segments that hold an unfilled template, filler, an error page or a script notice (problem 1).

A text is read as terms: beginnings of words and pairs of words, and two and three characters at a time where a script has no
spaces. Labelled exemplars stand in an inverted index from terms, searched by an automaton; document frequencies are counted
over all texts. Containment is scored in two ways. A passage window of an exemplar's length holds ``COVERAGE`` of the exemplar's
weight: the exemplar is there in its own words. Or a sentence is covered by ``KIND`` by the terms of the exemplars of one kind
and holds ``LIKE`` of the weight of one of them: it says the same in other words. An exemplar is retrieved by its heaviest terms
only, of which any such window must hold one, so retrieval loses nothing.

Filler is scored by the words of the treatise that it is cut from. As filler is often made of words like those, words that stand
among them and nowhere else in the whole corpus are learned, all of them. Weights depend on shares of texts (``RAREST``), not
on how many texts there are.
An unfilled place of a template is found by its syntax: those of public template languages, and a bracket around an instruction.

Defined results: null, empty and blank texts are no residue; a segment delivered twice gives one row.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cuelight.functions.batches import map_columns, spread
from cuelight.llm.exemplars import FILLER, UNITS, passages
from cuelight.llm.lookalikes import TO_LATIN, fold_all

#: Least share of an exemplar's weight that a window of its length must hold.
COVERAGE = 0.8
#: Least share of a sentence's weight that one kind of exemplars must cover, and of one exemplar's that it must hold.
KIND, LIKE = 0.6, 0.35
#: Terms that a sentence must share with the exemplar that it is like: words, pairs of characters. One of few words (BRIEF) shares one less.
SHARED, BRIEF = (3, 4), 4
#: Terms up to which an exemplar without a number is short: words, pairs of characters. Unless it is of kind
#: script, it counts only where KIND of its clause is covered.
SHORT = (4, 8)
#: Kinds whose messages are made of the same words cover a sentence together.
GROUP = {"template": "template", "repeated": "repeated", "error": "notice", "script": "notice"}
#: Words of a window of filler, the share of them that must be filler, and the share that makes a window filler's company.
WORDS, FILLED, COMPANY = 3, 0.75, 0.4
#: Learned filler words: least texts of each, and the least share of its texts in which it stands in filler's company.
SEEN, ALONE = 3, 0.9
#: Share of the texts under which all terms are as rare: else what no text holds would weigh more with every row, and sentences
#: that are found in a table would be missed in a larger one of the same texts.
RAREST = 1e-5
#: Texts that a worker remembers, and the longest of them; results do not depend on them.
MEMO, BRIEF_TEXT = 200_000, 200
#: First letters of a word that stand for its forms, and first syllables of a Korean one.
STEM, SYLLABLES = 4, 2

_name = r"(?:[A-Za-z_][A-Za-z0-9_.]{1,60}|\d{1,3}|[一-鿿々ァ-ヺー가-힣ぁ-ゖ]{2,16})"
#: The syntaxes of an unfilled place in public template languages; what stands in it must be a name, not words of speech.
SLOT = re.compile(
    r"\{\{\{?[#/^&>]?\s*~\s*\}?\}\}|[$#@*]\{\s*~\s*\}|\{\$?~\}|<%[=-]?\s*~\s*-?%>|\{%-?\s*(?:\w+\s+)?~\s*-?%\}|\[%\s*~\s*%\]|<\?=?\s*\$?~\s*\?>"
    r"|%\(~\)[sdf]|%~%|\$~\$|@@~@@|__~__|\[\[\s*~\s*\]\]|<<\s*~\s*>>|&lt;\s*~\s*&gt;|\*\|~\|\*".replace("~", _name)
)
#: Instructions that stand in the bracket of an unfilled place or behind it, and fields that are named there.
_order = r"(?:insert|enter|add|type|fill in|your) (?=\w)|placeholder|to be (?:added|announced|confirmed|determined)|einfügen|eingeben|insérer|saisir|insertar|escriba|ここ|此处|此處|여기"
_order_after = r"を?(?:入力|記入|挿入|入れる)|未設定|未入力|未定|が入ります|here|hier|ici|aquí|输入|填写|입력"
_field = "(?:first |last |full |your |company |user )?name|company|date|title|subject|address|e-?mail|phone|city|url|氏名|お名前|名前|会社名|社名|日付|題名|件名|番組名|商品名|担当者名|住所|姓名|公司|日期|标题|이름|날짜|제목"
BRACKET = re.compile(rf"[\[<{{【〔［〈(](?=[^\[\]<>{{}}【】〔〕［］〈〉()\n]{{1,60}}[\]>}}】〕］〉)])(?:(?:{_order})[^\]>}}】〕］〉)]*|[^\]>}}】〕］〉)\n]*?(?:{_order_after})[^\]>}}】〕］〉)\n]{{0,8}}|(?:{_field}))[\]>}}】〕］〉)]", re.I)
BEHIND = re.compile(rf"[<【〔［〈]{_name}[>】〕］〉](?=が入ります|を入力|を記入)")

_twins = re.compile("[" + "".join(TO_LATIN) + "]")
_digits = re.compile(r"\d{1,5}(?!\d)")
_fill = re.compile("(?:[○◯〇●]{2,}|[○◯])")
_end = re.compile(r"[。.!?…]+(?=\s|$|\x00|[^\x00-\x7f])|[。!?…]+|\n+|[;:](?=\s)|\s[–—|]\s")
_clause = re.compile(r"[、,，]|\s[-–—]\s|[:：](?!//)")
_gap = re.compile(r"[^\w○□|,\x00]+|_+")
_blank = re.compile("  +")
_js = re.compile(r"\bjs\b")
_keys = re.compile("(?:1234567890|0123456789)+")
_again = re.compile(r"^\s*(\S(?:.{0,11}?\S)?)\s*(?:\1\s*){2,}.{0,12}$")
_unit = re.compile("|".join(map(re.escape, UNITS)))
_spaceless = re.compile("[ぁ-ゖァ-ヺー一-鿿々฀-๿○□]")
_kana = re.compile("[ぁ-ゖー]+")
_bound = re.compile("[ぁ-ゖァ-ヺー一-鿿々฀-๿○□가-힣]")
_run = re.compile("[ぁ-ゖァ-ヺー一-鿿々฀-๿○□]+|[^ぁ-ゖァ-ヺー一-鿿々฀-๿○□ ]+")


def plain(texts: list[str]) -> list[str]:
    """The texts folded for the index: case, widths, numbers, unfilled places; one space around every word, | between
    sentences, a comma between clauses."""
    joined = "\x00".join(fold_all([t.replace("\x00", "").replace("|", " ") if "*|" not in t else t.replace("\x00", "") for t in texts]))
    if not joined.isascii():
        joined = _twins.sub(lambda m: TO_LATIN[m.group()], joined)
    joined = SLOT.sub(" □ ", joined)
    joined = BRACKET.sub(" □ ", BEHIND.sub(" □ ", joined))
    joined = _fill.sub("○", joined)
    if "123456789" in joined:
        joined = _keys.sub(" □ ", joined)
    joined = _digits.sub("0", joined)
    joined = _clause.sub(" , ", _end.sub(" | ", joined))
    joined = _gap.sub(" ", joined.lower())
    if "js" in joined:
        joined = _js.sub("javascript", joined)
    return [f" {t} " for t in _blank.sub(" ", joined).replace(" \x00", "\x00").replace("\x00 ", "\x00").strip().split("\x00")]


def _around(text: str, at: int) -> str:
    """The clause of a folded text at a place."""
    return re.split("[|,]", text[max(text.rfind("|", 0, at), text.rfind(",", 0, at)) + 1 :], maxsplit=1)[0]


def coarse(passage: str) -> list[str]:
    """The terms of a folded passage by which it is like another: beginnings of words, pairs of characters; endings in kana and
    single letters say nothing."""
    out = []
    for w in _run.findall(passage):
        if w in "|,":
            continue
        if _spaceless.match(w):
            out += [x for x in (w[i : i + 2] for i in range(len(w) - 1)) if not _kana.fullmatch(x)] or ([w] if len(w) == 1 else [])
        elif len(w) > 1 or not w.isalpha():
            size = SYLLABLES if "가" <= w[0] <= "힣" else STEM
            out.append(f" {w[:size]}" if len(w) >= size else f" {w} ")
    return out


def fine(passage: str) -> list[str]:
    """The terms by which a passage is the same as another: pairs of words, three characters; each a part of it."""
    out = []
    for part in re.split("[|,]", passage):
        words = part.split()
        for w in words:
            if _spaceless.search(w):
                out += [w[i : i + 3] for i in range(max(1, len(w) - 2))]
            else:
                out.append(f" {w[:SYLLABLES]}" if "가" <= w[0] <= "힣" else f" {w} ")
        out += [f" {a} {b} " for a, b in zip(words, words[1:]) if not _bound.search(a + b)]
    return out


class Index:
    """The inverted index: an automaton over the exemplars' terms and, with weights, their retrieval terms."""

    def __init__(self, exemplars: list[tuple[str, str]] | None = None):
        import ahocorasick

        labelled = passages() if exemplars is None else exemplars
        self.exemplars = []
        for (kind, _), text in zip(labelled, plain([x for _, x in labelled])):
            self.exemplars.append((kind, len(text), frozenset(fine(text)), frozenset(coarse(text))))
        self.exemplars.append(("template", 3, frozenset(["□"]), frozenset(["□"])))
        self.filler = frozenset(w for w in FILLER.split() if len(w) > 3)
        self.all = sorted(set().union(*(a | b for _, _, a, b in self.exemplars)) | {f" {w} " for w in self.filler})
        self.number = {t: i for i, t in enumerate(self.all)}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.number.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()

    def weigh(self, weight: dict[str, float], learned: frozenset = frozenset()) -> "Index":
        """With the weight of every term (that of "" is a term's without any text) and learned words of filler."""
        self.known, self.unknown = self.filler | learned, weight[""]
        self.done: dict[str, bool] = {}  # texts that a worker has looked at
        self.parts: dict[str, frozenset] = {}  # and the terms of their sentences, and what these say
        self.said: dict[str, tuple | None] = {}
        self.weight = [weight[t] for t in self.all]
        self.same, self.like, self.alike = [], [], []
        self.by_kind: dict[str, set[str]] = {}
        retrieves: list[dict[int, list[int]]] = [{}, {}]
        for kind, size, own, wide in self.exemplars:
            self.by_kind.setdefault(GROUP[kind], set()).update(wide)
            for k, terms, least in ((0, own, COVERAGE), (1, wide, LIKE)):
                ids = sorted((self.number[t] for t in terms), key=lambda i: -self.weight[i])
                total = left = sum(self.weight[i] for i in ids)
                at = len((self.same, self.like)[k])
                short = kind != "script" and len(wide) <= SHORT[any(map(_spaceless.search, wide))] and " 0 " not in wide and "□" not in wide
                (self.same, self.like)[k].append((kind, size, frozenset(ids), total, short))
                for i in ids:  # without these terms less than the least share is left
                    retrieves[k].setdefault(i, []).append(at)
                    left -= self.weight[i]
                    if left < least * total - 1e-9:
                        break
        self.retrieves, self.retrieves_like = retrieves
        return self

    def hits(self, text: str) -> list[tuple[int, int]]:
        """(end, number) of the terms that a folded text holds."""
        return [(end, i) for end, (i, _) in self.automaton.iter(text)]

    def residue(self, text: str) -> bool:
        """Whether a folded text holds a passage like an exemplar."""
        hits = self.hits(text)
        ends = [at for at, _ in hits]
        tried = set()
        wide: set[int] = set()
        there = {i for _, i in hits}
        for i in there:
            wide.update(self.retrieves_like.get(i, ()))
        for end, i in hits if not self.retrieves.keys().isdisjoint(there) else ():
            for e in self.retrieves.get(i, ()):
                kind, size, own, total, short = self.same[e]
                if (end, e) in tried:
                    continue
                tried.add((end, e))
                window = hits[bisect_left(ends, end - size) : bisect_right(ends, end + size)]
                near = {j for _, j in window if j in own}
                if sum(self.weight[j] for j in near) >= COVERAGE * total - 1e-9:
                    if not short or self.covered(_around(text, end), kind):
                        return True
        if wide:  # the exemplars of which the whole text holds enough
            weight, like = self.weight, self.like
            wide = {e for e in wide if sum(map(weight.__getitem__, there & like[e][2])) >= LIKE * like[e][3]}
        if wide:
            if self.parts_say(text, wide):
                return True
        return self.fills(text) or (_unit.search(text) is not None and any(map(self.typed, text.split("|"))))

    def typed(self, passage: str) -> bool:
        """Whether a sentence is one unit again and again that holds a word which is typed to fill a place."""
        unit = _again.match(passage)
        return unit is not None and any(u in unit.group(1) for u in UNITS)

    def covered(self, passage: str, kind: str) -> bool:
        """Whether the terms of a kind cover a sentence."""
        number, own = self.number, self.by_kind[GROUP[kind]]
        terms = {t: self.weight[number[t]] if t in number else self.unknown for t in coarse(passage)}
        return sum(w for t, w in terms.items() if t in own) >= KIND * sum(terms.values())

    def parts_say(self, text: str, candidates: set[int]) -> bool:
        """Whether a folded text, or a sentence or clause of it, says what one of the ``candidates`` does."""
        parts = text.split("|")
        clauses = [c for p in parts if "," in p for c in p.split(",")]
        if len(parts) > 1 and text.count(" |") == text.count("| ") == len(parts) - 1:  # its terms are those of its sentences
            whole = self.says(frozenset().union(*map(self.terms, parts)), bool(_spaceless.search(text)))
        else:
            whole = self.what(text)
        return any(got and self.said_otherwise(got, candidates) for got in (whole, *map(self.what, {*parts, *clauses})))

    def terms(self, passage: str) -> frozenset:
        got = self.parts.get(passage)
        if got is None:
            if len(self.parts) > MEMO:
                self.parts.clear()
            got = frozenset(coarse(passage))
            if len(passage) <= BRIEF_TEXT:
                self.parts[passage] = got
        return got

    def what(self, passage: str) -> tuple | None:
        """``says`` of a passage, remembered."""
        if passage in self.said:
            return self.said[passage]
        if len(self.said) > MEMO:
            self.said.clear()
        got = self.says(self.terms(passage), bool(_spaceless.search(passage)))
        if len(passage) <= BRIEF_TEXT:
            self.said[passage] = got
        return got

    def says(self, terms: frozenset, wide: bool) -> tuple | None:
        """The kinds that cover a passage of these terms, its terms of the index and how many it must share with an exemplar; if
        there are any."""
        number, weight = self.number, self.weight
        there = {number[t] for t in terms if t in number}
        there.discard(number.get(" 0 ", -1))  # any number is like any other
        least = SHARED[wide] - (2 < len(terms) <= BRIEF)
        if len(there) < least:
            return None
        total = sum(weight[number[t]] if t in number else self.unknown for t in terms)
        kinds = {kind for kind, own in self.by_kind.items() if sum(weight[number[t]] for t in terms if t in own) >= KIND * total}
        return (kinds, there, least) if kinds else None

    def said_otherwise(self, said: tuple, candidates: set[int]) -> bool:
        """Whether a passage that is covered by the terms of one kind (``says``) holds much of one exemplar of it."""
        kinds, there, least = said
        for e in candidates:
            kind, _, ids, all_of_it, _ = self.like[e]
            if GROUP[kind] in kinds:
                shared = ids & there
                if len(shared) >= least and sum(self.weight[j] for j in shared) >= LIKE * all_of_it:
                    return True
        return False

    def fills(self, text: str) -> bool:
        """Whether a window of words is filler."""
        words = text.split()
        own = [w in self.known for w in words]
        if sum(own) < WORDS:
            return False
        kept = [x for x, w in zip(own, words) if w not in "|,"]
        span = max(WORDS, min(len(kept), 2 * WORDS))
        return any(sum(kept[k : k + span]) >= max(WORDS, FILLED * len(kept[k : k + span])) for k in range(max(1, len(kept) - span + 1)))

    def company(self, text: str) -> list[str]:
        """The words of a folded text that stand in filler's company, if it is that."""
        words = [w for w in text.split() if w not in "|,"]
        own = sum(w in self.filler for w in words)
        return words if own >= WORDS - 1 and own >= COMPANY * len(words) else []


def statistics(texts: DataFrame, text_col: str = "text") -> tuple[dict[str, float], frozenset]:
    """The inverse document frequency of every term of the index over all texts, and the learned words of filler.

    One number a term of the index and the learned words come to the driver; the former are those of the exemplars, the
    latter filler's own vocabulary, words that hardly any other text has.
    """
    schema = StructType([StructField("of", StringType()), StructField("k", StringType()), StructField("a", LongType()), StructField("n", LongType())])

    def count(column: list) -> dict:
        many = Counter(t for t in column if t)
        found, seen = counted(list(many), list(many.values()), plain(list(many)))
        rows = [*(("term", str(i), 0, n) for i, n in found.items()), *(("word", w, among, n) for w, (among, n) in seen.items())]
        return {name: [r[k] for r in rows] for k, name in enumerate(schema.names)}

    return gathered(map_columns(texts.select(texts[text_col].alias("text")), count, schema))


def counted(texts: list[str], times: list[int], folded: list[str]) -> tuple[dict[int, int], dict[str, tuple]]:
    """Of distinct texts, how often each is there and how it is folded: the texts of each term of the index, by its number, -1
    for all; and of every word, those in filler's company and all."""
    index = _index()
    found: Counter = Counter({-1: sum(times)})
    seen: Counter = Counter()
    among: Counter = Counter()
    for text, n in zip(folded, times):
        for i in {i for _, i in index.hits(text)}:
            found[i] += n
        words = {w for w in text.split() if "a" <= w[0] <= "ɏ" and len(w) < 40 and w.isalpha()}
        if words:
            for w in words:
                seen[w] += n
            for w in {*index.company(text)} & words:
                among[w] += n
    return found, {w: (among[w], n) for w, n in seen.items()}


def gathered(counts: DataFrame) -> tuple[dict[str, float], frozenset]:
    """The statistics by counts (of, k, a, n) of terms and words, of which a are in filler's company."""
    rows = counts.where("of in ('term', 'word')").groupBy("of", "k").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    # the words that stand in filler's company only, and all counts of the index's terms
    learned = (F.col("a") >= SEEN) & (F.col("a") >= ALONE * F.col("n"))
    got = rows.where((F.col("of") == "term") | learned).collect()
    many = {int(r.k): int(r.n) for r in got if r.of == "term"}
    return weights(_index().all, many, many.get(-1, 0)), frozenset(r.k for r in got if r.of == "word")


def weights(terms: list[str], counts: dict[int, int], n: int) -> dict[str, float]:
    """The inverse document frequency of every term, of ``counts`` by its number in ``n`` texts, and that of "" for any other."""
    least = max(1.0, RAREST * n)
    return {t: math.log((n + 1) / (counts.get(i, 0) + least)) + 1 for i, t in enumerate(terms)} | {"": math.log((n + 1) / least) + 1}


_made: dict = {}


def _index(known: tuple | None = None) -> Index:
    """One index a worker process for each of the last statistics."""
    key = None if known is None else id(known)
    if key not in _made:
        for k in [k for k in _made if k is not None and k != key]:
            del _made[k]
        _made[key] = (Index() if known is None else Index().weigh(*known), known)
    return _made[key][0]


def flags(texts: list[str | None], known: tuple) -> list[bool]:
    """Whether each text is residue, by the ``statistics``; equal texts are looked at once."""
    index = _index(known)
    done = index.done
    fresh = list({t for t in texts if t and t not in done and not t.isspace()})
    found = {t: index.residue(p) for t, p in zip(fresh, plain(fresh))} if fresh else {}
    out = [found[t] if t in found else done.get(t, False) for t in texts]
    if len(done) > MEMO:
        done.clear()
    done.update((t, x) for t, x in found.items() if len(t) <= BRIEF_TEXT)
    return out


def folded_flags(folded: Iterable[str], known: tuple) -> list[bool]:
    """``flags`` of distinct texts that are folded already."""
    index = _index(known)
    return [index.residue(p) for p in folded]


def residue(segments: DataFrame, id_col: str = "seg_id", text_col: str = "text") -> DataFrame:
    """(``id_col``): the rows whose text holds residue."""
    rows = segments.select(segments[id_col], segments[text_col].alias("__text")).where("__text is not null")
    known = segments.sparkSession.sparkContext.broadcast(statistics(rows, "__text"))

    def keep(ids: list, texts: list) -> dict:
        return {id_col: list(dict.fromkeys(i for i, f in zip(ids, flags(texts, known.value)) if f))}

    return map_columns(spread(rows, id_col), keep, StructType([rows.schema[id_col]])).distinct()
