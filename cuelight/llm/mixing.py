"""Mixing sources to target shares of tokens (problem 8).

Each document is repeated as often as an inverted Poisson distribution says, at a point that its id's hash seeds, with the
source's rate as mean, at most the source's cap. The mixture is as large as the scarcest source allows, drawn at a rate of
its cap. The rate of every other source is found from its documents: each stands for the rates at which it enters a
first, second, ... time, read off a table of the distribution; a histogram of the tokens by these rates, of bounded size,
tells the rate whose mixture has the source's goal. Its range follows from the data: up to the cap, and down to a part of the
rate that the goal asks for. So the shares reached are the targets but for the size of single documents and of a bin. Copies
are exploded and shuffled globally.

Defined results: documents of a null source, of a source without target or without tokens are in no mixture; a target whose
source has no tokens has a share of 0 and the others keep their ratio; no target gives an empty mixture; caps under one
or null leave the source out; equal ids share a draw only in the same source and with the same text.
"""

from __future__ import annotations

from bisect import bisect_left
from math import lgamma

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from cuelight.functions.batches import map_columns
from cuelight.llm.bpe import VOCABULARY, count_tokens
from cuelight.session import cut

#: Bins of a source's histogram of rates, and how far under the rate that the goal asks for it begins.
BINS, UNDER = 4096, 16.0
#: Seed of the draws.
SEED = 8


def at_least(copies: int, rates: np.ndarray) -> np.ndarray:
    """P(N >= k; rate) of k = 1 ... ``copies``, a row each, rising with the rates."""
    top = int(copies + 12 * copies**0.5 + 40)
    steps = np.arange(top + 1)
    logs = np.array([lgamma(j + 1) for j in steps])
    mass = np.exp(steps[:, None] * np.log(rates)[None, :] - rates[None, :] - logs[:, None])
    return np.cumsum(mass[::-1], axis=0)[::-1][1 : copies + 1]


def entering(u: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The bins from which on points ``u`` of (0, 1) give at least 1, 2, ... copies (a column each): the first rate with
    P(N >= k) >= 1 - u, or the number of bins if there is none."""
    return np.stack([np.searchsorted(row, 1 - u) for row in table], axis=1)


def _each(values: dict, kind: str) -> Column:
    """The value of a row's source, of a small dimension."""
    return F.create_map(*(x for s, v in values.items() for x in (F.lit(s), F.lit(v).cast(kind))))[F.col("source")]


def drawn(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, dict, dict]:
    """The documents with tokens and the bins of their copies' rates; each source's share and cap, and the bin of its rate."""
    goal = {r.source: (r.share, int(r.cap)) for r in targets.where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()}
    rows = documents.select("doc_id", "source", "text").where(F.col("source").isin(list(goal)) & F.col("text").isNotNull())
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "source", F.xxhash64("text"), F.lit(SEED)))
    rows = cut(count_tokens(rows, ["doc_id", "source", "draw"], "text", vocabulary).where("tokens > 0"))
    if not goal:
        return rows.withColumn("bins", F.lit(None).cast("array<int>")), {}, {}
    # all tokens of a source, and those drawn at a rate of its cap: copies as often as 1 - u is at most P(N >= k)
    full = {s: [float(x) for x in at_least(cap, np.array([float(cap)]))[:, 0]] for s, (_, cap) in goal.items()}
    point = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("draw") / F.lit(2.0**64) + 0.5))
    most = F.create_map(*(x for s, v in full.items() for x in (F.lit(s), F.array(*map(F.lit, v)))))[F.col("source")]
    rows = rows.withColumn("u", point)
    copies = F.size(F.filter(most, lambda p: p >= 1 - F.col("u")))
    sums = {r.source: (r.all, r.most) for r in rows.groupBy("source").agg(F.sum("tokens").alias("all"), F.sum(F.col("tokens") * copies).alias("most")).collect()}
    live = {s: goal[s][0] for s in goal if s in sums and sums[s][1] > 0}
    share = {s: x / sum(live.values()) for s, x in live.items()}
    size = min((sums[s][1] / share[s] for s in live), default=0)
    low = {s: min(share[s] * size / sums[s][0] / UNDER, goal[s][1] / 2) for s in live}
    grid = {s: low[s] * (goal[s][1] / low[s]) ** (np.arange(BINS) / (BINS - 1)) for s in live}
    schema = StructType([*rows.schema.fields[:4], StructField("bins", ArrayType(IntegerType()))])
    tables: dict[str, np.ndarray] = {}

    def rate(ids: list, sources: list, draws: list, tokens: list, points: list) -> dict:
        u, names = np.array(points), np.array(sources, object)
        out: list = [None] * len(ids)
        for s in set(sources) & set(live):
            if s not in tables:
                tables[s] = at_least(goal[s][1], grid[s])
            own = np.flatnonzero(names == s)
            for i, row in zip(own, entering(u[own], tables[s])):
                out[i] = row[row < BINS].tolist()
        return {"doc_id": ids, "source": sources, "draw": draws, "tokens": tokens, "bins": out}

    rows = cut(map_columns(rows.select("doc_id", "source", "draw", "tokens", "u"), rate, schema))
    # tokens by source and bin; the table's size depends on the sources and bins only
    table: dict[str, list] = {s: [] for s in goal}
    entered = rows.select("source", "tokens", F.explode("bins").alias("bin")).groupBy("source", "bin").agg(F.sum("tokens").alias("n"))
    for r in entered.orderBy("source", "bin").collect():
        table[r.source].append((r.bin, r.n))
    found = {}
    for s in live:
        edges, total = [], 0
        for _, n in table[s]:
            total += n
            edges.append(total)
        want = share[s] * size
        at = bisect_left(edges, want)
        if at and (at == len(edges) or want - edges[at - 1] < edges[at] - want):
            at -= 1
        found[s] = table[s][at][0]
    return rows, {s: goal[s] for s in goal}, found


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``doc_id``, ``source``, ``copy``, ``tokens``): the mixture, a row a copy (from 1), in the order of a global shuffle."""
    rows, _, rate = drawn(documents, targets, vocabulary)
    if not rate:
        return rows.limit(0).select("doc_id", "source", F.lit(1).alias("copy"), "tokens")
    rows = rows.withColumn("at", _each(rate, "int")).withColumn("copies", F.expr("size(filter(bins, b -> b <= at))")).where("copies > 0")
    rows = rows.select("doc_id", "source", "tokens", "draw", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return rows.withColumn("place", F.xxhash64("draw", "copy", F.lit(SEED + 1))).repartitionByRange("place").sortWithinPartitions("place").select("doc_id", "source", "copy", "tokens")


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``source``, ``target_share``, ``max_repeats``, ``documents``, ``copies``, ``tokens``, ``actual_share``): the shares reached."""
    mixed = mixture(documents, targets, vocabulary).groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("copies"), F.sum("tokens").alias("tokens"))
    rows = targets.select("source", "target_share", "max_repeats").join(mixed, "source", "left").fillna(0, ["documents", "copies", "tokens"])
    total = F.sum("tokens").over(Window.partitionBy())  # a row a target
    return rows.select("source", "target_share", "max_repeats", "documents", "copies", "tokens", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"))
