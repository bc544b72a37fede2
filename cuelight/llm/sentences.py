"""Sentence boundaries across languages and scripts by a hidden-event n-gram model (problem 4).

Between two words stands either nothing or a hidden boundary event. The model is an n-gram model over words (single
characters where a script has no spaces) and the event: P(event | words before it) backs off from four tokens to one, and
the words after it are weighed by P(words | event) against P(words | no event, words before). The ends and starts of texts
are boundaries that are known, so they are the labels: a context that ends sentences also ends texts, in the share of
sentences that are a text's last, and one that never ends a text (an abbreviation, a filler, a comma) ends no sentence.
The posteriors come from the forward-backward recursion over a text's gaps, whose states are event and no event, as the
words before a gap reach back to an event at the gap before. Events inside a quotation count only if one follows it.

Where there is neither a mark nor a space that could end a sentence, every gap between two words (two characters where a
script has no spaces) is one for a second n-gram model of the same kind, ``Inner``: it is counted over the sentences that
the first one finds, without their marks and capitals, so it knows how sentences end and begin when nothing shows it.

The model is fitted on all texts: every distinct one is counted where it is read, in steps that each need the sums of the one
before, and the sums are broadcast. Their number grows with the number of different word sequences. All texts are split, whole.

Defined results: null, empty and blank texts have no sentence and no cut; a text delivered twice is split once.
"""

from __future__ import annotations

import gc
import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from math import exp, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from cuelight.functions.batches import map_columns
from cuelight.llm import lookalikes, residue
from cuelight.llm.lookalikes import INVISIBLE, TO_LATIN
from cuelight.session import cut

#: Tokens that the second model looks back on and log odds that it needs, in scripts without spaces and with them; and the least
#: share of the places after the last words of a gap that end a sentence, for its text to be looked at.
ORDER, SPACED, SURE, SURE_SPACED, ENDING = 5, 4, 4.0, 2.5, 0.05
#: Probability of a state that is taken as none.
EPSILON = 1e-5
#: Last words by which an end is looked for, in scripts with spaces and without.
LAST = (2, 3)
#: Weight of the shorter context in every backing off.
BACK = 8.0
#: Tokens before a gap that the event depends on, and after it that weigh in.
BEFORE, AFTER = 4, 3
#: Characters before a gap that often hold these tokens, in scripts without spaces; results do not depend on it.
NEAR = 6
#: A word of fewer texts is known by its shape only.
RARE = 4

#: Between the words of a key, and between a context and the words behind it: white space, so in no word.
SEP, THEN = "\x1f", "\x1e"

#: Entries of each memo of a worker; results do not depend on them.
MEMO = 200_000
MEMOS = ("near_lefts", "known_lefts", "lefts", "rights", "far_rights", "heads", "ratios", "keys", "begins", "events")

#: End marks, closers that belong to the sentence before them, and pairs of quotation marks.
MARKS, CLOSERS = "。｡．.!！?？…‥।", "」｣』”’»）)\"'］】〉》"
QUOTES = {"「": "」", "｢": "｣", "『": "』", "“": "”", "‘": "’", "«": "»", "„": "“”"}

_i = INVISIBLE
_gap = re.compile(f"(?P<m>[{MARKS}](?:[{_i}]*[{MARKS}])*)(?P<c>(?:[{_i}   ]*[{re.escape(CLOSERS)}])*)(?P<s>[\\s{_i}]*)|(?P<w>\\s[\\s{_i}]*)")
_alnum = re.compile("[0-9A-Za-z０-９Ａ-Ｚａ-ｚ]")
_spaceless = re.compile("[ぁ-ヿ一-鿿㐀-䶿々豈-﫿ｦ-ﾟ⺀-⿕฀-๿]")
_word = "A-Za-zªµºÀ-ÖØ-öø-ʯ̀-ͯͰ-ԯḀ-ỿऀ-ॣ॰-ॿᄀ-ᇿ가-힣"
_longer = re.compile(f"[0-9]+(?:[.:,][0-9]+)*|[{_word}]+(?:'[{_word}]+)*|\\s+|[。.!?…।]+")
_token = re.compile(f"{_longer.pattern}|.", re.S)
#: Characters that ``fold`` leaves as they are, next to any other of them.
_as_is = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ–—‘’“”、。〈-】〜ぁ-ゖァ-ヺー一-鿿가-힣]*")
_digit = re.compile("[1-9]")
_number, _wide_number = re.compile("[1-9]"), re.compile("[１-９]")
_tail = MARKS + CLOSERS + " \t\n\r　"
_quote = re.compile("[「」｢｣『』“”‘’«»„\"]")
_scripts = (("th", re.compile("[฀-๿]")), ("ko", re.compile("[ᄀ-ᇿ가-힣]")), ("hi", re.compile("[ऀ-ॿ]")), ("ja", re.compile("[ぁ-ヿｦ-ﾟ]")), ("zh", re.compile("[一-鿿⺀-⿕豈-﫿]")))

_dense = ("ja", "zh", "th")
_no_word = frozenset(MARKS + "、,，「『“‘«„")
#: Letters for which it matters whether words are brought to lower case or their text is.
_own_case = re.compile("[İΣ℀-⅏Ⱡ-ⷿꙀ-ꟿ]")
_latin = re.compile("[A-Za-zÀ-ɏ]")


def script(text: str) -> str:
    """The script group of a text."""
    if text.isascii():
        return "la"
    latin = len(_latin.findall(text))
    return next((n for n, p in _scripts if p.search(text) and 3 * len(p.findall(text)) > latin), "la")


def spans(text: str) -> list[tuple[int, int]]:
    """The quotations of a text: places of their opening and closing marks."""
    open_, out = [], []
    straight = -1
    for m in _quote.finditer(text):
        c, at = m.group(), m.start()
        if c == '"':
            if straight >= 0:
                out.append((straight, at))
                straight = -1
            else:
                straight = at
        elif open_ and c in QUOTES[open_[-1][0]]:
            out.append((open_.pop()[1], at))
        elif c in QUOTES:
            open_.append((c, at))
    return sorted(out)


def gaps(text: str) -> list[tuple[int, int, int, str]]:
    """Places where a sentence could end: where its words end, where it ends with its marks, where the next begins, marks."""
    out = []
    n = len(text)
    last = n
    while last and (text[last - 1].isspace() or text[last - 1] in _i_set):
        last -= 1
    first = 0
    while first < last and (text[first].isspace() or text[first] in _i_set):
        first += 1
    for m in _gap.finditer(text):
        begin = m.start()
        follow = m.end()
        if begin <= first or follow >= last:
            continue
        after = text[follow]
        if m.group("w") is not None:
            if after in MARKS or after in "」』”’»）)】" or text[begin - 1] in MARKS:
                continue
            before = text[begin - 1]
            if not (_spaceless.match(before) or _spaceless.match(after) or "ऀ" <= before <= "ॿ" or "ᄀ" <= before <= "ᇿ" or "가" <= before <= "힣" or after.isupper() or after.isdigit() or after in "「『“‘«„\"¿¡"):
                continue
            out.append((begin, begin, follow, ""))
            continue
        marks = m.group("m")
        if marks in ".．" and not m.group("c") and not m.group("s").strip(_i_all) and _alnum.match(text[:begin].rstrip(_i_all)[-1:] if text[begin - 1] in _i_set else text[begin - 1]) and _alnum.match(after):
            continue  # inside a number or an abbreviation
        if after in MARKS or after in ",，、､;；:：":
            continue
        closed = m.end("c")
        if m.group("c"):  # a straight quotation mark after white space opens
            tail = m.group("c")
            cut = re.search(f"[   ][{_i}]*[\"'’]$", tail)
            if cut and m.group("s") == "":
                closed = m.start("c") + cut.start()
                follow = closed + 1
        out.append((begin, closed, follow, marks))
    return out


_i_set = {chr(c) for a, b in re.findall("(.)-(.)", INVISIBLE) for c in range(ord(a), ord(b) + 1) if c < 0xE0000} | set(INVISIBLE.replace("-", ""))


_i_all = "".join(_i_set)
_twin = re.compile("[" + "".join(TO_LATIN) + "]")
_all_marks = MARKS + "".join(chr(c) for a, b in re.findall("(.)-(.)", INVISIBLE) for c in range(ord(a), ord(b) + 1)) + INVISIBLE.replace("-", "")
_closing = CLOSERS + _all_marks[len(MARKS) :] + "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def last_marks(text: str) -> int:
    """Where the end marks that a text ends with begin, -1 without any; closers, white space and invisible characters may follow."""
    end = len(text.rstrip(_closing))
    if not end or text[end - 1] not in MARKS:
        return -1
    at = len(text[:end].rstrip(_all_marks))
    while text[at] not in MARKS:
        at += 1
    return at


def shape(token: str) -> str:
    """What is known of a rare word."""
    c = token[0]
    if c.isdigit():
        return "<0>"
    if "가" <= c <= "힣":
        return "<ko>" + token[-1]
    if "ऀ" <= c <= "ॿ":
        return "<hi>" + token[-1]
    if len(token) > 1:
        return "<Aa>" if c.isupper() else "<aa>"
    return "<A>" if c.isupper() else "<x>"


def fold(text: str) -> str:
    """``lookalikes.fold``, not asked where it changes nothing."""
    return text if _as_is.fullmatch(text) else lookalikes.fold(text)


def alike(text: str) -> str:
    """The text with all digits alike: nothing that is read of a text depends on them, and more of it is remembered."""
    text = _number.sub("0", text)
    return text if text.isascii() else _wide_number.sub("０", text)


def tokens(part: str) -> list[str]:
    """Words and characters of a part of a text, folded; numbers are all alike."""
    if not _as_is.fullmatch(part):
        part = _twin.sub(lambda m: TO_LATIN[m.group()], fold(part))
    return ["<0>" if t[0].isdigit() else " " if t.isspace() else t for t in _token.findall(part)]


class Inner:
    """The hidden-event n-gram model of texts that show no boundary: P(word or event | words before), by Witten-Bell."""

    def __init__(self, sentences: Counter | None = None, sums: dict | None = None):
        if sums is None:
            many = self.weighed(list(sentences), list(sentences.values()))
            longest = self.grams(list(many), list(many.values()))
            sums = self.shorter(list(longest), list(longest.values()))
        self.counts: dict[str, float] = sums  # by the script and the words
        self.after: dict[str, tuple] = {}
        self.types: Counter = Counter()
        for key, n in sums.items():
            context = key.rpartition(SEP)[0]
            total, kinds = self.after.get(context, (0.0, 0))
            self.after[context] = total + n, kinds + 1
            if SEP not in context:
                self.types[context] += 1
        # last words (LAST of them) of which a share of at least ENDING is followed by the event, as they stand in a text
        self.endings, self.firsts = set(), {"0"}
        for key, n in sums.items():
            if "<b>" in key:
                s, *words = key.split(SEP)
                if words[0] == "<b>" and len(words) == 2:
                    self.firsts.add(words[1][0])
                if words.pop() == "<b>" and len(words) == LAST[s in _dense] and "<b>" not in words and n >= ENDING * self.after[key.rpartition(SEP)[0]][0]:
                    self.endings.add(("" if s in _dense else " ").join(words))
        self.memo: dict[tuple, list[int]] = {}

    @staticmethod
    def weighed(sentences: list[str], times: list[int]) -> dict[str, float]:
        """How much distinct sentences say, by what they are but for their numbers. These are whole multiples of a small share,
        so sums do not depend on the order."""
        out: dict[str, float] = defaultdict(float)
        for sentence, n in zip(sentences, times):
            out[alike(sentence)] += round((1 + log(n)) * 2**20) / 2**20  # copies say a little more
        return out

    @classmethod
    def grams(cls, sentences: list[str], many: list[float]) -> dict[str, float]:
        """The counts of the longest word sequence up to each word of ``weighed`` sentences."""
        out: dict[tuple, float] = defaultdict(float)
        for sentence, n in zip(sentences, many):
            words = cls.names(sentence)
            if len(words) < 2:
                continue
            s = script(sentence)
            order = ORDER if s in _dense else SPACED
            row = (s, "<b>", *words, "<b>")
            for i in range(3, min(order + 1, len(row)) + 1):
                out[row[:i]] += n
            head = row[:1]
            for i in range(order + 2, len(row) + 1):
                out[head + row[i - order : i]] += n
        return {SEP.join(k): n for k, n in out.items()}

    @staticmethod
    def shorter(grams: list[str], counts: list[float]) -> dict[str, float]:
        """The counts of all word sequences that end as ``grams`` do."""
        out: dict[str, float] = defaultdict(float)
        for k, n in zip(grams, counts):
            s, _, rest = k.partition(SEP)
            while rest:
                out[s + SEP + rest] += n
                rest = rest.partition(SEP)[2]
        return out

    def search(self):
        """The automaton of the endings, one a worker process."""
        import ahocorasick

        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for e in self.endings:
                self.automaton.add_word(e.replace("<0>", "0"), len(e))
            self.automaton.make_automaton()
        return self.automaton

    automaton = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"} | {"memo": {}}

    @staticmethod
    def plain(text: str) -> str:
        """A text as the endings are written."""
        return _digit.sub("0", (text if text.isascii() else fold(text)).lower())

    def may_end(self, plain: str) -> bool:
        """Whether words that end sentences stand in a text before one that may begin a sentence."""
        t = plain.rstrip(_tail)
        last = len(t) - 1
        if not self.endings:
            return False
        for end, _ in self.search().iter(t):
            if end < last and (t[end + 1] if t[end + 1] != " " else t[end + 2 : end + 3]) in self.firsts:
                return True
        return False

    @staticmethod
    def words(text: str) -> list[tuple[str, int, int]]:
        """The words of a text, folded and in lower case, with their places; white space, marks and invisible characters are none."""
        out = []
        folded = fold(text)
        same = len(folded) == len(text)  # else places are those of the text, and its words are folded one by one
        for m in _token.finditer(folded if same else text):
            t = m.group()
            if not same and not t.isascii():
                t = fold(t)
            t = t.strip().lower()
            if t and t[0] not in MARKS and t not in CLOSERS and t[0] not in "、,，「『“‘«„":
                out.append(("<0>" if t[0].isdigit() else t, m.start(), m.end()))
        return out

    @classmethod
    def names(cls, text: str) -> list[str]:
        """``words`` without their places."""
        if not _as_is.fullmatch(text):
            folded = lookalikes.fold(text)
            if len(folded) != len(text) or _own_case.search(folded):
                return [w for w, _, _ in cls.words(text)]
            text = folded
        return ["<0>" if t[0].isdigit() else t for t in _token.findall(text.lower()) if not (t[0] in _no_word or t.isspace() or t in CLOSERS)]

    def p(self, s: str, before: tuple, word: str) -> float:
        """P(word | words before), interpolated with shorter contexts."""
        got = 1 / (self.types.get(s, 0) + 1000)
        words = ""
        for k in range(len(before) + 1):
            if k:
                words = SEP + before[-k] + words
            seen = self.after.get(s + words)
            if seen is None:
                break
            n, kinds = seen
            got = (self.counts.get(s + words + SEP + word, 0.0) + kinds * got) / (n + kinds)
        return got

    def cuts(self, text: str, s: str) -> list[int]:
        """Where a sentence ends in a text that shows nothing, by the posteriors of forward-backward over all its gaps."""
        known = self.memo.get((s, text))
        if known is not None:
            return known
        out: list[int] = []
        names = self.names(text) if self.may_end(self.plain(text)) else []
        words = None
        glue = "" if s in _dense else " "
        many = LAST[s in _dense]
        places = [i for i in range(many - 1, len(names) - 1) if glue.join(names[i + 1 - many : i + 1]) in self.endings and (names[i + 1][0] if names[i + 1] != "<0>" else "0") in self.firsts]
        if places:
            on = self.posterior(names, s, places)
            for i, x in zip(places, on):
                if x <= (SURE if s in _dense else SURE_SPACED):
                    continue
                words = words or self.words(text)
                between = text[words[i][2] : words[i + 1][1]]
                half = (i + 1) // 2  # the same again says nothing of its words
                twice = names[i + 1 : i + 2] == names[i : i + 1] or half and names[i + 1 - half : i + 1] == names[i + 1 : i + 1 + half]
                if not between.strip(_i_all + " ") and not twice and names[i + 1][0] not in "ー~〜～":
                    out.append(words[i][2])
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[s, text] = out
        return out

    def unmarked(self, text: str, cuts: list[int], found: list, s: str) -> list[int]:
        """``cuts`` and those that nothing shows, outside quotations and the places ``found`` that were decided."""
        if not self.endings:
            return cuts
        text = alike(text)
        at = [0, *cuts, len(text)]
        more = [a + x for a, b in zip(at, at[1:]) for x in self.cuts(text[a:b], s)]
        if not more:
            return cuts
        shown = [g for g in found if g[3] or s in _dense]
        decided, inner = {g[0] for g in shown} | {g[1] for g in shown}, spans(text)
        return sorted({*cuts, *(x for x in more if x not in decided and not any(p < x <= q for p, q in inner))})

    def posterior(self, names: list[str], s: str, places: list[int]) -> list[float]:
        """log odds of an event behind each of the words ``places``, of which no other has one (the search's beam); the
        context reaches back to an event at the gap before. What all paths share is left out."""
        back = (ORDER if s in _dense else SPACED) - 1
        edge = ("<b>",)
        open_ = set(places)
        steps = {}  # log weight of the word behind a gap, or of the end, by (event at the gap before, event at this gap)

        def context(i: int) -> tuple:
            return tuple((([*edge] if i < back else []) + names[max(0, i - back) : i])[-back:])

        for i in range(1, len(names) + 1):
            here, before = i - 1 in open_, i - 2 in open_
            if not (here or before):
                continue
            word = names[i] if i < len(names) else "<b>"
            row = []
            for c in (context(i), (*edge, names[i - 1])) if before else (context(i),):
                on = log(self.p(s, c, "<b>")) + log(self.p(s, edge, word)) if here else -1e9
                row.append((log(self.p(s, c, word)), on))
            steps[i - 1] = row
        order = sorted(steps)
        forward, f, last = {}, (0.0, -1e9), -2
        for k in order:
            row = steps[k]
            if k - 1 != last:
                f = (_add(*f), -1e9)
            f = tuple(_add(f[0] + row[0][x], f[1] + row[1][x]) if len(row) > 1 else f[0] + row[0][x] for x in (0, 1))
            forward[k], last = f, k
        out, b, after = {}, (0.0, 0.0), None
        for k in reversed(order):
            if after != k + 1:
                b = (_add(*b) if after is not None and len(steps[after]) == 1 else b[0],) * 2
            out[k] = forward[k][1] + b[1] - forward[k][0] - b[0]
            row = steps[k]
            b = tuple(_add(r[0] + b[0], r[1] + b[1]) for r in (row if len(row) > 1 else row * 2))
            after = k
        return [out[i] for i in places]


class Model:
    """Counts of the hidden-event n-gram model, of ``texts`` or of the sums of the steps over all distinct texts (``fit``)."""

    def __init__(self, texts: list[str] | None = None):
        self.known, self.word, self.ends, self.share = set(), Counter(), {}, {}
        self.first, self.after, self.kinds = {}, {}, Counter()
        self.forget()
        self.inner = None
        if texts is None:
            return
        copies = Counter(texts)
        read = [(t, n, script(t), gaps(t)) for t, n in copies.items()]
        many = self.tokens_of(copies)
        self.name_by(self.names_of(list(many), list(many.values())))
        ends, pairs = self.edges_of(read)
        self.end_by({k: x for k, x in ends.items() if x[1] > 1})
        self.go_on_by(self.insides_of(list(pairs), list(pairs.values())))
        parts = self.parts_of([(t, n, self.marked(t, found, s)) for t, n, s, found in read])
        self.inner = Inner(parts)

    def forget(self) -> None:
        """Empties what a worker remembers."""
        for memo in MEMOS:
            setattr(self, memo, {})

    def __getstate__(self) -> dict:
        return self.__dict__ | {memo: {} for memo in MEMOS}

    @staticmethod
    def tokens_of(texts: Iterable[str]) -> Counter:
        """The distinct texts that each word is in."""
        out: Counter = Counter()
        for t in texts:
            if not _as_is.fullmatch(t):
                t = _twin.sub(lambda m: TO_LATIN[m.group()], fold(t))
            out.update({"<0>" if w[0].isdigit() else " " if w.isspace() else w for w in {*_longer.findall(t), *_longer.sub("", t)}})
        return out

    @staticmethod
    def names_of(words: list[str], many: list[int]) -> dict[str, tuple]:
        """The same by what words are known by, and whether that is themselves."""
        out: dict[str, list] = defaultdict(lambda: [0, 0])
        for w, n in zip(words, many):
            e = out[w if n >= RARE else shape(w)]
            e[0] += n >= RARE
            e[1] += n
        return out

    def name_by(self, sums: dict[str, tuple]) -> None:
        for w, (known, n) in sums.items():
            self.word[w] = n
            if known:
                self.known.add(w)
        self.words_seen = sum(self.word.values()) + 1

    def edges_of(self, read: list[tuple]) -> tuple[dict[str, tuple], dict[str, int]]:
        """Of texts (text, copies, script, gaps): how often each context ends a text and is in one, and how texts begin; and how
        often words follow a gap with its context. Copies of a text say nothing more."""
        lasts: dict[str, int] = defaultdict(int)
        many: dict[str, int] = defaultdict(int)
        pairs: dict[tuple, int] = defaultdict(int)
        for t, _, s, found in read:
            original, t = t, alike(t)
            body = t.rstrip()
            marks = last_marks(t)
            stop = len(body) if marks < 0 else marks
            tail = self.keys_of(self.left(t, stop, t[stop : len(body)], s))
            own = {*tail}
            if found:
                inner = spans(t) if _quote.search(t) else ()
                if inner:
                    found = [g for g in found if not any(a < g[0] and g[1] <= b for a, b in inner)]
                at = [0, *(g[2] for g in found)]
                parts = [fold(original[a:b]).strip() for a, b in zip(at, [*(g[0] for g in found), len(t) if marks < 0 else marks])]
                for k, (begin, end, follow, _) in enumerate(found):
                    left = self.left(t, begin, t[begin:end], s)
                    if parts[k] != parts[k + 1]:  # the same again says nothing of its words
                        own.update(self.keys_of(left))
                    pairs[left, self.right(t, follow)] += 1
            for c in tail:
                lasts[c] += 1
            for c in own:
                many[c] += 1
            for c in self.begin_keys(self.right(t.strip(), 0), s):
                many[c] += 1
        return {c: (lasts.get(c, 0), n) for c, n in many.items()}, {SEP.join(left) + THEN + SEP.join(r): n for (left, r), n in pairs.items()}

    def keys_of(self, left: tuple) -> tuple:
        """The keys of the contexts of a gap or an end."""
        got = self.keys.get(left)
        if got is None:
            if len(self.keys) > MEMO:
                self.keys.clear()
            got = self.keys[left] = tuple(SEP.join(("end", *c)) for c in self.contexts(left))
        return got

    def begin_keys(self, r: tuple, s: str) -> tuple:
        """The keys of the first words of a text."""
        got = self.begins.get((r, s))
        if got is None:
            if len(self.begins) > MEMO:
                self.begins.clear()
            got = self.begins[r, s] = tuple(SEP.join(("first", s, *r[:k])) for k in range(len(r) + 1))
        return got

    def end_by(self, sums: dict[str, tuple]) -> None:
        firsts: dict = {}
        for k, (e, n) in sums.items():
            of, *c = k.split(SEP)
            (self.ends if of == "end" else firsts)[tuple(c)] = (e, n)
        # the share of sentences that are their text's last, by script
        for s in {c[0] for c in self.ends}:
            strong = [self.ends[c] for c in self.ends if len(c) == 2 and c[0] == s and c[1][:1] in "。!?।" and c[1]]
            a, b = sum(x[0] for x in strong), sum(x[1] for x in strong)
            self.share[s] = min(0.9, max(0.05, a / b)) if b else 0.5
        self.first = {c: n for c, (_, n) in firsts.items()}

    def insides_of(self, pairs: list[str], counts: list[int]) -> dict[str, int]:
        """The words behind gaps that hardly end a sentence."""
        out: dict[str, int] = defaultdict(int)
        hardly: dict[str, tuple | None] = {}
        for k, n in zip(pairs, counts):
            context, _, rest = k.partition(THEN)
            if context not in hardly:
                left = tuple(context.split(SEP))
                hardly[context] = (SEP.join((left[0], "")), SEP.join((left[0], *left[-2:]))) if self.event(left) < 0.2 else None
            if hardly[context]:
                a, b = hardly[context]
                out[a] += n
                out[b] += n
                for w in rest.split(SEP) if rest else ():
                    a, b = a + SEP + w, b + SEP + w
                    out[a] += n
                    out[b] += n
        return out

    def go_on_by(self, sums: dict[str, int]) -> None:
        self.after = {tuple(k.split(SEP)): n for k, n in sums.items()}
        for x in (self.first, self.after):  # kinds of words that follow each context
            for k in x:
                if len(k) > 1:
                    self.kinds[k[:-1]] += 1

    @staticmethod
    def parts_of(split: list[tuple]) -> Counter:
        """The sentences of texts (text, copies, cuts), with their copies."""
        out: Counter = Counter()
        for t, n, cuts in split:
            at = [0, *cuts, len(t)]
            for a, b in zip(at, at[1:]):
                out[t[a:b].strip()] += n
        return out

    def name(self, t: str) -> str:
        return t if t in self.known else shape(t)

    def left(self, text: str, begin: int, marks: str, s: str, since: int = 0) -> tuple:
        """The context before a gap: script, up to BEFORE tokens (a boundary among them) and the marks."""
        at = max(since, begin - (12 if s in _dense else 28))
        if s in _dense and begin - NEAR >= at:
            near = (text[begin - NEAR : begin], marks, s)
            got = self.near_lefts.get(near)
            if got is None:
                if len(self.near_lefts) > MEMO:
                    self.near_lefts.clear()
                # behind a character that is a token, the tokens are those of the longer part; enough of them are all that counts
                ts = [t for t in tokens(near[0])[1:] if t != " "] if _spaceless.match(near[0]) else []
                got = self.near_lefts[near] = self._named(ts, marks, s) if len(ts) >= BEFORE else ()
            if got:
                return got
        part = text[at:begin]
        key = (part, at == since, marks, s)
        got = self.known_lefts.get(key)
        if got is None:
            if len(self.known_lefts) > MEMO:
                self.known_lefts.clear()
            got = self.known_lefts[key] = self._left(part, at > since, marks, s)
        return got

    def _left(self, part: str, inside: bool, marks: str, s: str) -> tuple:
        ts = tokens(part)
        if inside and ts and len(ts) > BEFORE:
            ts = ts[1:]
        return self._named([*([] if inside else ["<b>"]), *(t for t in ts if t != " ")], marks, s)

    def _named(self, ts: list[str], marks: str, s: str) -> tuple:
        m = fold(marks)
        m = "".join(dict.fromkeys("…" if c == "…" or c == "." and "..." in m else c for c in m if c in MARKS))
        return (s, *(t if t == "<b>" else self.name(t) for t in ts[-BEFORE:]), m + ("" if len(marks) == 0 or marks[-1] in MARKS else "q"))

    def right(self, text: str, follow: int) -> tuple:
        """The first words behind a gap: those of a short part, if another token stands behind them there."""
        part = text[follow : follow + 8]
        got = self.rights.get(part)
        if got is None:
            got = self._right(part, len(part) == 8)
        if got == ():
            part = text[follow : follow + 24]
            got = self.far_rights.get(part)
            if got is None:
                if len(self.far_rights) > MEMO:
                    self.far_rights.clear()
                got = self.far_rights[part] = self._first(tokens(part))
        return got

    def _right(self, part: str, more: bool) -> tuple:
        if len(self.rights) > MEMO:
            self.rights.clear()
        ts = tokens(part)
        got = self.rights[part] = self._first(ts) if not more or len(ts) > AFTER + 3 else ()
        return got

    def _first(self, ts: list[str]) -> tuple:
        return tuple([self.name(t) for t in ts[: AFTER + 2] if t != " "][:AFTER])

    def ahead(self, text: str, follow: int, s: str) -> tuple:
        """``right``, of the characters that weigh in."""
        if s not in _dense:
            return self.right(text, follow)
        part = text[follow : follow + 8]
        got = self.heads.get(part)
        if got is None:
            if len(self.heads) > MEMO:
                self.heads.clear()
            got = self.heads[part] = self._first(tokens(part))
        return got

    @staticmethod
    def contexts(left: tuple) -> list[tuple]:
        """The left context and its shorter forms, each with the script and the marks; an unknown Latin word without a mark
        says nothing."""
        if left[-1] == "" and len(left) > 2 and left[-2] in ("<aa>", "<Aa>", "<A>"):
            return [(left[0], "")]
        return [(left[0], *left[k:]) for k in range(1, len(left))]

    def event(self, left: tuple) -> float:
        """P(event | context)."""
        got = self.events.get(left)
        if got is not None:
            return got
        p = 0.5
        share = self.share.get(left[0], 0.5)
        for c in reversed(self.contexts(left)):
            e, n = self.ends.get(c, (0, 0))
            if n:
                p = min(1.0, (e / share + BACK * p) / (n + BACK))
        if len(self.events) > MEMO:
            self.events.clear()
        got = self.events[left] = min(max(p, 1e-6), 1 - 1e-6)
        return got

    def words(self, left: tuple, r: tuple) -> float:
        """log P(words | event) / P(words | no event)."""
        s, total = left[0], 0.0

        def p(counts: dict, context: tuple, w: str, lower: float) -> float:
            n, kinds = counts.get(context, 0), max(1, self.kinds.get(context, 0))
            return (counts.get((*context, w), 0) + kinds * lower) / (n + kinds) if n else lower

        for k, w in enumerate(r):
            lower = (self.word.get(w, 0) + 1) / self.words_seen
            on = p(self.first, (s, *r[:k]), w, lower)
            off = p(self.after, (s, *left[-2:], *r[:k]), w, p(self.after, (s, "", *r[:k]), w, lower))
            total += log(on / off)
        return max(-6.0, min(6.0, total))

    def odds(self, text: str, begin: int, end: int, follow: int, s: str, since: int) -> float:
        """log odds of an event at a gap, the last event being at ``since``."""
        left = self.left(text, begin, text[begin:end], s, since)
        got = self.lefts.get(left)
        if got is None:
            p = self.event(left)
            if len(self.lefts) > MEMO:
                self.lefts.clear()
            got = self.lefts[left] = (left[-2:], log(p / (1 - p)), 0.5 if p > 0.98 or p < 0.02 else 1.0)
        tail, prior, weight = got
        key = (s, tail, self.ahead(text, follow, s))
        lr = self.ratios.get(key)
        if lr is None:
            if len(self.ratios) > MEMO:
                self.ratios.clear()
            lr = self.ratios[key] = self.words((s, *tail), key[2])
        return prior + lr * weight

    def cuts(self, text: str) -> list[int]:
        """Where a sentence ends and another follows, as characters from the start."""
        found, s = gaps(text), script(text)
        cuts = self.marked(text, found, s)
        return cuts if self.inner is None else self.inner.unmarked(text, cuts, found, s)

    def marked(self, text: str, found: list, s: str) -> list[int]:
        """Where a sentence ends at one of the gaps ``found``."""
        if not found:
            return []
        text = alike(text)
        inner = spans(text) if _quote.search(text) else []
        # the gaps outside quotations, and those that close one, first
        outer = [g for g in found if not any(a < g[0] and g[1] <= b for a, b in inner)] if inner else found
        on = self.posterior(text, outer, s)
        cuts = [g for g, p in zip(outer, on) if p > 0.5]
        if inner and len(outer) < len(found):
            ends = {g[1] for g in cuts}
            starts = {len(text) - len(text.lstrip()), *(g[2] for g in cuts)}
            for a, b in inner:
                if a in starts and b + 1 in ends:  # the quotation is whole sentences, and an event follows it
                    within = [g for g in found if a < g[0] and g[1] < b]
                    cuts += [g for g, p in zip(within, self.posterior(text, within, s, a + 1)) if p > 0.5]
        return sorted({g[1] for g in cuts})

    def posterior(self, text: str, found: list, s: str, since: int = 0) -> list[float]:
        """P(event) of each gap by forward-backward; the states are no event and event. Each step's weights are probabilities
        given the state before, so the backward messages are one everywhere and the forward ones are the posteriors. What a
        state of a probability under EPSILON would say is not asked for."""
        if not found:
            return []
        start = since + len(text[since:]) - len(text[since:].lstrip())
        out, p, before = [], 0.0, 0
        for begin, end, follow, _ in found:
            q = 0.0
            if p < 1 - EPSILON:
                q = (1 - p) * _share(self.odds(text, begin, end, follow, s, start))
            if p > EPSILON:  # after an event at the gap before, the context reaches back to that event only
                q += p * _share(self.odds(text, begin, end, follow, s, before))
            out.append(q)
            p, before = q, follow
        return out


def _share(odds: float) -> float:
    """The probability of log odds."""
    return 1 / (1 + exp(-odds)) if odds > -50 else 0.0


def _add(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi + log(1 + exp(lo - hi)) if hi - lo < 50 else hi


@contextmanager
def _no_search() -> Iterator[None]:
    """Batches and models are many small objects without cycles: they are not searched for any."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _packed(*columns: list) -> bytes:
    """A batch of texts or sums in one value: a small part of its rows' size in the checkpoint."""
    return zlib.compress(pickle.dumps(columns, pickle.HIGHEST_PROTOCOL), 1)


def _unpacked(pack: bytes) -> tuple:
    return pickle.loads(zlib.decompress(pack))


def _steps(rows: DataFrame, step: Callable) -> DataFrame:
    """(``of``, ``pack``): ``step`` gives of the columns of a batch, or of a pack, the next pack (of texts) and sums by what they
    are of. They are kept at the shared checkpoint, as each is read by a later step."""
    packs = rows.columns == ["of", "pack"]

    def run(*columns: list) -> dict:
        out: dict = {"of": [], "pack": []}
        for batch in columns[1] if packs else [columns]:
            with _no_search():
                pack, sums = step(*(_unpacked(batch) if packs else batch))
                for of, x in [("texts", pack), *((of, _packed(*_columns(own))) for of, own in sums.items() if own)]:
                    if x:
                        out["of"].append(of)
                        out["pack"].append(x)
        return out

    return cut(map_columns(rows, run, StructType([StructField("of", StringType()), StructField("pack", BinaryType())])))


#: Sums by key; they are whole numbers, or whole multiples of one small share, so their order does not matter.
_sums = StructType([StructField("k", StringType()), StructField("a", DoubleType()), StructField("n", DoubleType())])


def _columns(sums: dict) -> tuple[list, list, list]:
    """Keys and values of sums, which are one number (n) or two (a, n)."""
    values = list(sums.values())
    if values and isinstance(values[0], (tuple, list)):
        return list(sums), [x[0] for x in values], [x[1] for x in values]
    return list(sums), [0] * len(values), values


def _texts(steps: DataFrame) -> DataFrame:
    return steps.where("of = 'texts'")


def _total(steps: DataFrame, of: str) -> DataFrame:
    """The sums of all batches."""

    def read(_: list, packs: list) -> dict:
        out: dict = {"k": [], "a": [], "n": []}
        for pack in packs:
            for name, column in zip(out, _unpacked(pack)):
                out[name] += column
        return out

    return map_columns(steps.where(F.col("of") == of), read, _sums).groupBy("k").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))


def _then(sums: DataFrame, step: Callable) -> DataFrame:
    """The sums of a step over the keys of ``sums``."""

    def run(k: list, n: list) -> dict:
        with _no_search():
            return dict(zip(_sums.names, _columns(step(k, n))))

    got = map_columns(sums.select("k", "n"), run, _sums)
    return got.groupBy("k").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))


def _got(sums: DataFrame, *columns: str) -> dict:
    """Sums at the driver."""
    got = sums.select("k", *columns).toArrow()
    own = [got[c].to_pylist() for c in columns]
    return dict(zip(got["k"].to_pylist(), zip(*own) if len(own) > 1 else own[0]))


def _copies(texts: DataFrame, text_col: str) -> DataFrame:
    """The distinct texts in packs (text, copies, folded for the index of residue), with residue's counts."""
    rows = texts.select(texts[text_col].alias("k")).where("k <> ''").groupBy("k").agg(F.count("*").alias("n"))

    def read(k: list, n: list) -> tuple:
        folded = residue.plain(k)
        found, seen = residue.counted(k, n, folded)
        own = [(t, i, p) for t, i, p in zip(k, n, folded) if t.strip(" \t\n\x0b\f\r")]
        return _packed(*zip(*own)) if own else None, {"term": {str(i): (0, x) for i, x in found.items()}, "filler": seen}

    return _steps(rows, read)


def _fit(copies: DataFrame, known: tuple, of_residue: bool) -> tuple[Model, DataFrame]:
    """The model, and packs of the texts with what the first model splits; those of residue only if that is wanted."""
    context = copies.sparkSession.sparkContext
    weight = context.broadcast(known)

    def parse(texts: tuple, times: tuple, folded: tuple) -> tuple:
        own = [(t, 0 if f else n) for t, n, f in zip(texts, times, residue.folded_flags(folded, weight.value)) if of_residue or not f]
        if not own:
            return None, {}
        read = [(t, n, script(t), gaps(t)) for t, n in own]
        return _packed(read), {"word": Model.tokens_of(t for t, n in own if n)}

    m = Model()
    read = _steps(_texts(copies), parse)
    m.name_by(_got(_then(_total(read, "word"), Model.names_of), "a", "n"))
    named = context.broadcast(m)

    def edges(read: list) -> tuple:
        ends, pairs = named.value.edges_of([x for x in read if x[1]])
        return None, {"end": ends, "pair": pairs}

    seen = _steps(_texts(read), edges)
    m.end_by(_got(_total(seen, "end").where("n > 1"), "a", "n"))
    ended = context.broadcast(m)
    m.go_on_by(_got(_then(_total(seen, "pair"), lambda k, n: ended.value.insides_of(k, n)), "n"))
    first = context.broadcast(m)

    def split(read: list) -> tuple:
        own = [(t, first.value.marked(t, found, s), found, s) for t, _, s, found in read]
        return _packed(own), {"part": Model.parts_of([(t, n, cuts) for (t, cuts, _, _), (_, n, _, _) in zip(own, read) if n])}

    packs = _steps(_texts(read), split)
    grams = _then(_then(_then(_total(packs, "part"), Inner.weighed), Inner.grams), Inner.shorter)
    m.inner = Inner(sums=_got(grams, "n"))
    return m, _texts(packs)


def fit(texts: DataFrame, known: tuple, text_col: str = "text") -> Model:
    """The model of all texts; ``known`` are residue's statistics."""
    return _fit(_copies(texts, text_col), known, False)[0]


def boundaries(segments: DataFrame, id_col: str = "seg_id", text_col: str = "text", of_residue: bool = False) -> DataFrame:
    """(``id_col``, ``cut``): every place in a text where one sentence ends and another follows. Residue is split only if
    that is wanted (``of_residue``). Every distinct text is split once and joined with its rows."""
    rows = segments.select(segments[id_col], segments[text_col].alias("__text")).where("__text is not null")
    copies = _copies(rows, "__text")
    counts = [_total(copies, of).withColumn("of", F.lit(name)) for of, name in (("term", "term"), ("filler", "word"))]
    known = residue.gathered(counts[0].unionByName(counts[1]))
    model, packs = _fit(copies, known, of_residue)
    inner = segments.sparkSession.sparkContext.broadcast(model.inner)

    def split(_: list, packs: list) -> dict:
        out: dict = {"__k": [], "__cuts": []}
        for pack in packs:
            with _no_search():
                for t, cuts, found, s in _unpacked(pack)[0]:
                    cuts = inner.value.unmarked(t, cuts, found, s)
                    if cuts:
                        out["__k"].append(t)
                        out["__cuts"].append(cuts)
        return out

    found = map_columns(packs, split, StructType([StructField("__k", StringType()), StructField("__cuts", ArrayType(LongType()))]))
    return rows.join(found, F.col("__text") == F.col("__k")).select(id_col, F.explode("__cuts").alias("cut")).distinct()


def sentences(segments: DataFrame, id_col: str = "seg_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``sentence``, ``text``): the sentences of every text in order, residue too, numbered from 1, without outer white space."""
    rows = segments.select(segments[id_col], segments[text_col].alias("text")).where("text is not null and text rlike '\\\\S'").dropDuplicates([id_col])
    cuts = boundaries(segments, id_col, text_col, of_residue=True).groupBy(id_col).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    rows = rows.join(cuts, id_col, "left").withColumn("cuts", F.expr("concat(array(0L), coalesce(cuts, array()), array(cast(length(text) as bigint)))"))
    rows = rows.select(id_col, F.posexplode(F.expr("transform(sequence(2, size(cuts)), i -> substring(text, cast(cuts[i - 2] + 1 as int), cast(cuts[i - 1] - cuts[i - 2] as int)))")).alias("p", "s"))
    return rows.select(id_col, (F.col("p") + 1).alias("sentence"), F.expr("regexp_replace(s, '^\\\\s+|\\\\s+$', '')").alias("text"))
