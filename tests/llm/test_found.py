"""Every query of the training-data operators over the small tables, with checks of what it must hold."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from cuelight.llm import bpe, lookalikes, plans
from tests.oracle import same


def read(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, data, name):
    same(spark, data, plans.QUERIES[name], plans.SQL[name])


COLUMNS = {
    "p1_found": ["seg_id"],
    "p2_found": ["seg_id"],
    "p3_found": ["tab", "id_a", "id_b"],
    "p4_found": ["seg_id", "cut"],
    "p6_found": ["cue_id", "line_no", "speaker"],
    "p7_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "area"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_no_duplicate_rows(spark, data, name):
    df = plans.QUERIES[name](spark, data)
    assert df.columns == COLUMNS[name]
    got = [str(r) for r in df.collect()]
    assert got and len(set(got)) == len(got)


def test_pieces_stay_within_limits_and_join_to_the_text(spark, data):
    limits = {r.config: r for r in read(spark, data, "size_limits").collect()}
    segments = {r.seg_id: r for r in read(spark, data, "segments").collect()}
    got = defaultdict(list)
    for r in plans.QUERIES["p2_pieces"](spark, data).collect():
        got[r.seg_id].append(r)
    assert got
    for seg, own in got.items():
        s, own = segments[seg], sorted(own, key=lambda r: r.piece)
        limit, text = limits[s.config], s.text or ""
        assert [r.piece for r in own] == list(range(1, len(own) + 1))
        at = 0
        for r in own:
            t = r.text or ""
            assert len(t) <= limit.max_chars and text[r.offset : r.offset + len(t)] == t and r.offset <= at <= r.offset + len(t)
            at = r.offset + len(t)
            if r.start_ms is not None:
                assert r.end_ms - r.start_ms <= limit.max_ms
        assert at == len(text)
        long = limit.max_ms is not None and s.start_s is not None and s.end_s is not None and (s.end_s - s.start_s) * 1000 > limit.max_ms
        if not long:
            for a, b in zip(own, own[1:]):
                assert a.offset + len(a.text) - b.offset == min(limit.overlap_chars, a.offset + len(a.text))


def test_pairs_look_the_same_and_all_are_found(spark, data):
    """Against all pairs of a group, from the canonical texts."""
    texts = {("segments", r.seg_id): r for r in read(spark, data, "segments").collect()} | {("cues", r.cue_id): r for r in read(spark, data, "cues").collect()}
    form = {(r.tab, r.id): r.canonical for r in plans.QUERIES["p3_canonical"](spark, data).collect()}
    group = defaultdict(list)
    for (tab, i), r in texts.items():
        if form[tab, i]:
            group[tab, r.stem, r.reel, form[tab, i]].append((i, r.text.strip()))
    want = {(tab, min(a, b), max(a, b)) for (tab, *_), own in group.items() for a, x in own for b, y in own if a < b and x != y}
    assert {tuple(r) for r in plans.QUERIES["p3_found"](spark, data).collect()} == want


def test_classes_expand_to_the_pairs(spark, data):
    own = defaultdict(list)
    for r in plans.QUERIES["p3_classes"](spark, data).collect():
        own[r.tab, r.class_id].append((r.id, r.spelling_id))
    want = {(tab, min(a, b), max(a, b)) for (tab, _), rows in own.items() for a, x in rows for b, y in rows if a < b and x != y}
    assert want and {tuple(r) for r in plans.QUERIES["p3_found"](spark, data).collect()} == want


def test_ids_decode_to_the_texts(spark, data):
    texts = {r.doc_id: r.text for r in read(spark, data, "documents").collect()}
    e = bpe.Encoder(open(bpe.VOCABULARY, "rb").read())
    got = plans.QUERIES["p7_ids"](spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        assert "".join(e.entry[i] for i in r.ids).encode("latin-1").decode() == (texts[r.doc_id] or "")


def test_mixture_keeps_caps_and_shares(spark, data):
    targets = {r.source: r for r in read(spark, data, "mix_targets").collect()}
    rows = plans.QUERIES["p8_mixture"](spark, data).collect()
    times = Counter(r.doc_id for r in rows)
    assert rows and len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    assert all(times[r.doc_id] <= targets[r.source].max_repeats for r in rows)
    again = plans.QUERIES["p8_mixture"](spark, data).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert sum(r.actual_share for r in plans.QUERIES["p8_shares"](spark, data).collect()) == pytest.approx(1)


def test_seeds_mostly_keep_their_areas(spark):
    folder = "/root/testdata/sf0.01"
    given, got = defaultdict(set), defaultdict(set)
    for r in read(spark, folder, "area_labels").collect():
        given[r.doc_id].add(r.area)
    for r in plans.QUERIES["p9_found"](spark, folder).collect():
        got[r.doc_id].add(r.area)
    hits = sum(len(given[d] & got[d]) for d in given)
    assert hits / sum(map(len, given.values())) > 0.85


def test_canonical_is_stable():
    for t in ("ｶﾞﾛｰﾄﾞ　①²", "éa​b c", "⼈が", "ﬁne…"):
        assert lookalikes.fold(lookalikes.fold(t)) == lookalikes.fold(t)
    assert lookalikes.fold("ｶﾞﾛｰﾄﾞ　①²") == "ガロード ①²"
