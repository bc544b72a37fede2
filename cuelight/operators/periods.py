"""Continuous periods and gaps of overlapping intervals (problem 5), a mergeable aggregate.

The state of the aggregate is a sorted list of disjoint, not touching intervals, kept in rows of ``CHUNK`` intervals at most.
Partial states are built where the rows are read (one an Arrow batch, key and hour), merged in a reduction tree of two
rounds (by key, hour and ``SALT`` first, so that a key that holds most rows is spread, then by key and hour), and the hours of
a key are joined by what is reached before them. A round reads its rows in the order of key and hour and hands a list on
as soon as the next one begins, so a task holds one key's hour, however many rows or keys it has: a list of disjoint
whole-millisecond intervals that start in one hour has at most 1.8 million entries. What runs over all of a key's hours is
one number a chunk; the lists are joined with it and are never in one task.

Defined results: rows with a missing time, or an end at or before the start, are left out; touching intervals are one
period; repeated rows change nothing; null keys are a key of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: Milliseconds of one block of a key's time, intervals of one row, and groups that a key's hour is merged in at first.
HOUR_MS, CHUNK, SALT = 3_600_000, 512, 16


def _disjoint(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted disjoint intervals of every code. The stable sort is a natural merge, linear in runs that are sorted already."""
    order = np.argsort(start, kind="stable")
    order = order[np.argsort(code[order], kind="stable")]
    code, start, end = code[order], start[order], end[order]
    # a running maximum that restarts with each code: ranks of the ends are lifted apart by the code
    values, rank = np.unique(end, return_inverse=True)
    lift = code * np.int64(len(values))
    reach = values[np.maximum.accumulate(rank + lift) - lift]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(code)) - 1
    return code[first], start[first], reach[last]


def _combine(table: pa.Table, keys: list[str], start: np.ndarray, end: np.ndarray, schema: pa.Schema) -> tuple[pa.RecordBatch, np.ndarray, int]:
    """Rows of lists for each distinct value of the key columns; the code of each such row, and that of the last row of ``table``."""
    code = np.zeros(len(start), np.int64)
    for k in keys:
        c = pc.fill_null(pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False)
        code = np.unique(code * (int(c.max(initial=0)) + 2) + c + 1, return_inverse=True)[1]
    codes, starts, ends = _disjoint(code, start, end)
    heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    place = np.arange(len(codes)) - np.repeat(heads, np.diff(np.append(heads, len(codes))))
    cuts = np.flatnonzero(place % CHUNK == 0)
    offsets = pa.array(np.append(cuts, len(codes)).astype(np.int32))
    sample = np.unique(code, return_index=True)[1][codes[cuts]]
    columns = [table[k].combine_chunks().take(pa.array(sample)) for k in keys]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (starts, ends)]
    parts = pa.array(place[cuts] // CHUNK)
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*columns, parts, *lists], schema)], schema=schema), codes[cuts], int(code[-1])


def disjoint_lists(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, ``__hour``, ``__part``, ``__starts``, ``__ends``): the state of the aggregate for each key and hour of starts, in
    chunks numbered from 0."""
    rows = intervals.select(*(intervals[k] for k in keys), intervals[start].cast("bigint").alias("__s"), intervals[end].cast("bigint").alias("__e"))
    rows = rows.where("__s < __e").withColumn("__hour", F.expr(f"floor(__s / {HOUR_MS})").cast("bigint"))
    group = [*keys, "__hour"]
    lists = [StructField(n, ArrayType(LongType(), True), True) for n in ("__starts", "__ends")]
    schema = StructType([*(rows.schema[k] for k in group), StructField("__part", IntegerType()), *lists])

    out = to_arrow_schema(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _combine(pa.Table.from_batches([b]), group, b["__s"].to_numpy(), b["__e"].to_numpy(), out)[0]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = out.names
        held = None  # the list of the key and hour that was read last, as far as it is merged
        for b in batches:
            if not b.num_rows:
                continue
            new = pa.RecordBatch.from_arrays([b[n].cast(f.type) for n, f in zip(names, out)], schema=out)
            t = pa.Table.from_batches([new] if held is None else [held, new])
            starts, ends = (t[c].combine_chunks() for c in ("__starts", "__ends"))
            rows = t.select(group).take(pc.list_parent_indices(starts))
            merged, codes, last = _combine(rows, group, starts.flatten().to_numpy(zero_copy_only=False), ends.flatten().to_numpy(zero_copy_only=False), out)
            stays = codes == last
            if not stays.all():
                yield merged.filter(pa.array(~stays))
            held = merged.filter(pa.array(stays))
        if held is not None:
            yield held

    salt = F.expr(f"pmod(spark_partition_id(), {SALT})").alias("__salt")
    some = rows.select(*group, "__s", "__e").mapInArrow(partial, schema).select("*", salt).repartition(*group, "__salt").drop("__salt")
    some = some.sortWithinPartitions(*group).mapInArrow(merge, schema)
    return some.repartition(*group).sortWithinPartitions(*group).mapInArrow(merge, schema)


def periods_and_gaps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, ``kind``, ``start_ms``, ``end_ms``): each ``'period'`` and each ``'gap'`` between two periods of a key.

    ``start`` and ``end`` are columns of whole milliseconds.
    """
    chunks = disjoint_lists(intervals, keys, start, end)
    on = [*keys, "__hour", "__part"]
    by = Window.partitionBy(*keys).orderBy("__hour", "__part")
    before = by.rowsBetween(Window.unboundedPreceding, -1)

    same: Column = F.lit(True)
    for k in on:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    # what earlier chunks reach, and this chunk's intervals that begin after it
    told = chunks.select(*on, F.element_at("__ends", -1).alias("__last"))
    told = told.select(*on, F.max("__last").over(before).alias("__reach"), F.max("__last").over(Window.partitionBy(*keys)).alias("__all"))
    rows = chunks.alias("l").join(told.alias("r"), same).select("l.*", "r.__reach", "r.__all")
    rows = rows.withColumn("__n", F.size(F.filter("__starts", lambda s: F.col("__reach").isNull() | (s > F.col("__reach")))))
    rows = rows.where("__n > 0").withColumn("__from", F.expr("size(__starts) - __n + 1"))
    # the end before each such start: the interval before it in the chunk, or what was reached before
    inner = F.expr("case when __from > 1 then greatest(element_at(__ends, __from - 1), coalesce(__reach, element_at(__ends, __from - 1))) else __reach end")
    rows = rows.withColumn("__before", inner)
    rows = rows.withColumn("__starts", F.expr("slice(__starts, __from, __n)")).withColumn("__ends", F.expr("slice(__ends, __from, __n)"))
    # a chunk's last period ends where the next chunk's first one has its end before, so only numbers are needed for it
    last = rows.select(*on, "__before", "__all", F.element_at("__starts", -1).alias("start_ms"))
    last = last.select(*keys, F.lit("period").alias("kind"), "start_ms", F.coalesce(F.lead("__before").over(by), "__all").alias("end_ms"))
    inner = rows.select(
        *keys,
        F.explode(
            F.expr(
                "concat(transform(slice(__starts, 1, __n - 1), (s, i) -> named_struct('kind', 'period', 'start_ms', s, 'end_ms', __ends[i])),"
                " filter(transform(__starts, (s, i) -> named_struct('kind', 'gap', 'start_ms', case when i = 0 then __before else __ends[i - 1] end, 'end_ms', s)), g -> g.start_ms is not null))"
            )
        ).alias("x"),
    )
    return inner.select(*keys, "x.kind", "x.start_ms", "x.end_ms").unionByName(last)


def whole_ms(seconds: str) -> Column:
    """Seconds of three decimals as whole milliseconds."""
    return F.round(F.col(seconds) * 1000).cast("bigint")
