"""Token ids of every text under a public byte-level BPE vocabulary (problem 7).

Bytes are mapped to Latin-1 so that pyahocorasick finds every vocabulary entry in a piece. The encoder walks the piece
with the longest entry at each place and goes back to shorter ones where two neighbours would not stay apart under the
merges; whether a pair stays apart is memoised. A position that was once left as a dead end is never entered again, so
the walk is linear in the length of the piece.

Defined results: null and empty texts give an empty list; text that looks like a special token is ordinary text; repeated
rows give repeated rows; only the id and the ids are returned, whatever other columns there are.
"""

from __future__ import annotations

import base64
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from cuelight.functions.batches import map_columns, spread

#: Where the public vocabulary files lie.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text into pieces before the merges, as published with the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the cache of pieces; it is emptied when full, so results never depend on it.
CACHE = 200_000


class Encoder:
    """The encoder of one rank file, given as bytes."""

    def __init__(self, ranks: bytes):
        import ahocorasick
        import regex

        self.id = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.entry = {i: s for s, i in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.id.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.split = regex.compile(PIECES).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.cache: dict[str, list[int]] = {}

    def merged(self, s: str) -> list[int]:
        """The ids of a short string by plain merging, lowest rank first; for the memos only."""
        parts = list(s)
        while len(parts) > 1:
            rank, at = min((self.id.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether the merges make this entry from its own bytes at all."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(self.entry[token]) == [token]
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbours stay the tokens that they are."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self.merged(self.entry[left] + self.entry[right]) == [left, right]
        return known

    def prefix(self, token: int) -> int:
        """The next shorter entry that begins this one, or -1."""
        known = self.shorter.get(token)
        if known is None:
            s = self.entry[token]
            known = self.shorter[token] = next((self.id[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.id), -1)
        return known

    def piece(self, s: str) -> list[int]:
        """The ids of one piece, its bytes as Latin-1."""
        if s in self.id and self.stands(self.id[s]):
            return [self.id[s]]
        n = len(s)
        longest, reach = [-1] * n, [0] * n
        for end, (size, token) in self.automaton.iter(s):
            at = end + 1 - size
            if size > reach[at]:
                reach[at], longest[at] = size, token
        entry, tokens, pos, open_ = self.entry, [], 0, bytearray(b"\x01") * (n + 1)
        token = longest[0]
        while pos < n:
            last = tokens[-1] if tokens else -1
            while token >= 0:
                end = pos + len(entry[token])
                if open_[end] and self.stands(token) and (last < 0 or self.apart(last, token)):
                    break
                token = self.prefix(token)
            if token >= 0:
                tokens.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
            else:
                open_[pos] = 0
                token = tokens.pop()
                pos -= len(entry[token])
        return tokens

    def ids(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one."""
        out: list[int] = []
        cache = self.cache
        for p in self.split(text or ""):
            got = cache.get(p)
            if got is None:
                got = self.piece(p.encode("utf-8", "replace").decode("latin-1"))
                if len(cache) >= CACHE:
                    cache.clear()
                if len(p) <= 64:
                    cache[p] = got
            out += got
        return out


_encoders: dict[int, Encoder] = {}


def encoder(ranks: bytes) -> Encoder:
    """One encoder a worker process and vocabulary."""
    key = hash(ranks)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(``id_col``, ``ids``): the token ids of every row's text. The rank file is read at the driver and broadcast."""
    ranks = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rows = documents.select(documents[id_col], documents[text_col])
    schema = StructType([StructField(id_col, rows.schema[0].dataType), StructField("ids", ArrayType(IntegerType(), False), False)])

    def batch(ids: list, texts: list) -> dict:
        e = encoder(ranks.value)
        return {id_col: ids, "ids": [e.ids(t) for t in texts]}

    return map_columns(spread(rows, id_col), batch, schema)


def count_tokens(documents: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of token ids of the text (0 for null and empty)."""
    from pyspark.sql.types import LongType

    ranks = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rows = documents.select(*(documents[c] for c in keep), documents[text_col].alias("__text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("tokens", LongType(), False)])

    def batch(*columns: list) -> dict:
        e = encoder(ranks.value)
        return dict(zip(keep, columns)) | {"tokens": [len(e.ids(t)) for t in columns[-1]]}

    return map_columns(spread(rows, keep[0]), batch, schema)
