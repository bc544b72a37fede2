"""The windows of the turns against a plain loop over the cues of every reel."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from cuelight.llm import lookalikes, plans, turns


def test_turns_equal_a_loop(spark, data):
    cues = {r.cue_id: r for r in spark.read.parquet(f"{data}/cues.parquet").collect()}
    read = {c: [(k + 1, *turns.read_line(x)) for k, x in enumerate(lookalikes.fold(r.text or "").split("\n"))] for c, r in cues.items()}
    here, anywhere, best = defaultdict(Counter), defaultdict(Counter), {}
    for c, r in cues.items():
        for _, label, _, _ in read[c]:
            i = label and turns.speaker_id(label)
            for x in {turns.speaker_id(y) for y in r.ruby or [] if y} if i else ():
                if x != i:
                    here[r.stem, r.reel, x][i] += 1
                    anywhere[x][i] += 1

    def name(stem, reel, i):
        if re.fullmatch("[ぁ-ゖー]+", i):
            for counts, all_of_it in ((here.get((stem, reel, i)), False), (anywhere.get(i), True)):
                if counts and (not all_of_it or 2 * max(counts.values()) > sum(counts.values())):
                    return max(counts.items(), key=lambda x: (x[1], x[0]))[0]
        return i

    for r in spark.read.parquet(f"{data}/cue_stats.parquet").collect():
        for key, n in (r.speakers or {}).items():
            i = (r.stem, r.reel, name(r.stem, r.reel, turns.speaker_id(key)))
            best[i] = min(best.get(i, (1, "")), (-n, key))
    want, reel, who, last = set(), None, None, None
    for c, r in sorted(cues.items(), key=lambda x: (x[1].stem, x[1].reel, x[1].start_s, x[0])):
        if (r.stem, r.reel) != reel:
            reel, who, last = (r.stem, r.reel), None, None
        for line, label, spoken, _ in read[c] if r.text is not None else ():
            who = name(r.stem, r.reel, turns.speaker_id(label)) if label is not None else who
            if spoken and who is not None:
                if who != last:
                    want.add((c, line, best[r.stem, r.reel, who][1]))
                last = who
    assert {tuple(x) for x in plans.QUERIES["p6_found"](spark, data).collect()} == want
