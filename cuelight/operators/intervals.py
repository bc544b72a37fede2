"""Interval algebra on whole milliseconds, and joins of points and spans.

Every operator takes the key columns of a recording; sweeps run within a key. Range joins are equi-joins: spans are cut
into buckets of time, so a key with very many rows is spread over its buckets and no cross product of a key is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.operators.periods import periods_and_gaps

#: Milliseconds of one bucket of a range join.
BUCKET_MS = 60_000


def merge(spans: DataFrame, keys: list[str], start: str = "a", end: str = "b") -> DataFrame:
    """(keys, a, b): the union of a key's spans; touching spans are one, empty and inverted ones are left out."""
    rows = periods_and_gaps(spans, keys, start, end).where("kind = 'period'")
    return rows.select(*keys, F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))


def holes(merged: DataFrame, keys: list[str], minimum: int = 0, totals: DataFrame | None = None) -> DataFrame:
    """(keys, a, b): the holes of merged spans longer than ``minimum``, from 0 on, and up to ``total`` of ``totals`` if given."""
    by = Window.partitionBy(*keys).orderBy("a")
    rows = merged.select(*keys, F.greatest(F.lag("b").over(by), F.lit(0)).alias("p"), "a")
    rows = rows.select(*keys, F.coalesce("p", F.lit(0)).cast("bigint").alias("a"), F.col("a").alias("b"))
    if totals is not None:
        ends = merged.groupBy(*keys).agg(F.greatest(F.max("b"), F.lit(0)).alias("a")).join(totals, keys)
        rows = rows.unionByName(ends.select(*keys, "a", F.col("total").cast("bigint").alias("b")))
    return rows.where(F.col("b") - F.col("a") > minimum)


def subtract(left: DataFrame, right: DataFrame, keys: list[str], minimum: int = 1000) -> DataFrame:
    """(keys, a, b): the parts of merged ``left`` that merged ``right`` does not cover, of ``minimum`` at least."""

    def edges(spans: DataFrame, x: int, y: int) -> DataFrame:
        pick = F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(x).alias("dx"), F.lit(y).alias("dy")), F.struct(F.col("b").alias("t"), F.lit(-x).alias("dx"), F.lit(-y).alias("dy"))))
        return spans.select(*keys, pick.alias("e")).select(*keys, "e.*")

    steps = edges(left, 1, 0).unionByName(edges(right, 0, 1)).groupBy(*keys, "t").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
    by = Window.partitionBy(*keys).orderBy("t")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select(*keys, F.col("t").alias("a"), F.lead("t").over(by).alias("b"), F.sum("dx").over(upto).alias("x"), F.sum("dy").over(upto).alias("y"))
    # a change of the left alone may part a piece that right leaves whole only where two left spans touch, which merging excludes
    return steps.where(f"x > 0 and y = 0 and b - a >= {minimum}").select(*keys, "a", "b")


def split_long(spans: DataFrame, longest: int) -> DataFrame:
    """The spans cut into pieces of ``longest`` and a rest; other columns are carried, ``piece`` counts from 0."""
    count = F.greatest(F.lit(1), F.ceil((F.col("b") - F.col("a")) / longest)).cast("int")
    rows = spans.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.withColumn("a", F.col("a") + F.col("piece") * longest).withColumn("b", F.least("b", F.col("a") + longest))


def padded(runs: DataFrame, keys: list[str], pad: int, total: str) -> DataFrame:
    """Runs widened by ``pad`` on both sides; a gap narrower than twice that is shared, half rounded down to each side."""
    by = Window.partitionBy(*keys).orderBy("a")
    rows = runs.withColumn("__p", F.col("a") - F.lag("b").over(by)).withColumn("__n", F.lead("a").over(by) - F.col("b"))
    left = F.when(F.col("__p") < 2 * pad, F.floor(F.col("__p") / 2)).otherwise(pad)
    right = F.when(F.col("__n") < 2 * pad, F.floor(F.col("__n") / 2)).otherwise(pad)
    rows = rows.withColumn("__a", F.greatest(F.lit(0), F.col("a") - left))
    b = F.when(F.col("__n") < 2 * pad, F.col("b") + right).otherwise(F.least(F.col(total), F.col("b") + right))
    return rows.withColumn("b", b.cast("bigint")).withColumn("a", F.col("__a").cast("bigint")).drop("__a", "__p", "__n")


def to_samples(spans: DataFrame, keys: list[str], samples: int | Column, per_ms: int = 16) -> tuple[DataFrame, DataFrame]:
    """Merged (keys, a, b) in samples, clamped to [0, samples]; and (keys, received, dropped, clamped, merged). A column
    ``samples`` is of ``spans``; where it is null, only the lower bound holds."""
    limit = samples if isinstance(samples, Column) else F.lit(samples)
    rows = spans.select(*keys, (F.col("a") * per_ms).alias("ra"), (F.col("b") * per_ms).alias("rb"), limit.cast("bigint").alias("__limit"))
    rows = rows.withColumn("a", F.greatest("ra", F.lit(0))).withColumn("b", F.least("rb", "__limit"))
    valid = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("ra").isNotNull()) & F.col("rb").isNotNull()
    kept = valid & (F.col("b") > F.col("a"))
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("received"),
        F.count_if(~F.coalesce(kept, F.lit(False))).alias("dropped"),
        F.count_if((F.col("ra") < 0) | (F.col("rb") > F.col("__limit"))).alias("clamped"),
        F.count_if(kept).alias("kept"),
    )
    merged = merge(rows.where(kept).select(*keys, "a", "b"), keys)
    left = merged.groupBy(*keys).agg(F.count("*").alias("left"))
    counts = counts.join(left, keys, "left").select(*keys, "received", "dropped", "clamped", (F.col("kept") - F.coalesce("left", F.lit(0))).alias("merged"))
    return merged, counts


def raster(spans: DataFrame, keys: list[str], samples_per_frame: int = 256, per_ms: int = 16) -> DataFrame:
    """(keys, frame): the distinct frames that spans of milliseconds touch. They are merged as intervals before they are listed."""
    first = F.greatest(F.lit(0), F.floor(F.col("a") * per_ms / samples_per_frame)).cast("bigint")
    last = F.floor(F.col("b") * per_ms / samples_per_frame).cast("bigint")
    timed = spans.where("a is not null and b is not null")
    rows = merge(timed.select(*keys, first.alias("a"), (last + 1).alias("b")), keys)
    return rows.select(*keys, F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("frame"))


def bucketed(spans: DataFrame, a: str, b: str) -> DataFrame:
    """The spans once for each bucket of time that they touch."""
    return spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(a) / BUCKET_MS), F.floor(F.greatest(F.col(a), F.col(b) - 1) / BUCKET_MS))))


def _same(keys: list[str]) -> Column:
    """Equal keys of ``l`` and ``r``, nulls too."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return on


def within(spans: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The spans (__from, __to) cut to the time that ``others`` (__from, __to) of the key have from first to last; spans
    outside it go. So a span with a corrupt end is not listed for buckets that nothing else touches."""
    reach = others.groupBy(*keys).agg(F.min("__from").alias("__lo"), F.max("__to").alias("__hi"))
    rows = spans.alias("l").join(reach.alias("r"), _same(keys)).select("l.*", "r.__lo", "r.__hi")
    rows = rows.withColumn("__from", F.greatest("__from", "__lo")).withColumn("__to", F.least("__to", "__hi"))
    return rows.where("__from < __to").drop("__lo", "__hi")


def points_in(points: DataFrame, spans: DataFrame, keys: list[str], twice: Column, how: str = "inner") -> DataFrame:
    """Points joined with the spans [a, b) that hold them. ``twice`` is twice the point, so halves stay whole numbers."""
    p = points.withColumn("__twice", twice).withColumn("__bucket", F.floor(F.col("__twice") / (2 * BUCKET_MS)))
    at = F.floor(F.col("__twice") / 2)
    s = spans.withColumnsRenamed({"a": "span_a", "b": "span_b"}).where("span_b > span_a")
    s = within(s.withColumns({"__from": F.col("span_a"), "__to": F.col("span_b")}), p.select(*keys, at.alias("__from"), (at + 1).alias("__to")), keys)
    s = bucketed(s, "__from", "__to").drop("__from", "__to")
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "__bucket")]
    hit = (F.col("p.__twice") >= 2 * F.col("s.span_a")) & (F.col("p.__twice") < 2 * F.col("s.span_b"))
    condition = hit
    for x in on:
        condition = condition & x
    joined = p.alias("p").join(s.alias("s"), condition, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__twice", "__bucket")
    return joined.select("p.*", *(F.col(f"s.{c}") for c in s.columns if c not in (*keys, "__bucket"))).drop("__twice", "__bucket")


def overlapping(left: DataFrame, spans: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``left`` (a, b) that overlap a span strictly on both sides (``left_semi``), or none (``left_anti``). A row with a
    missing time overlaps nothing. Equal rows of ``left`` are as many in the result."""
    # what a row touches depends on its keys and times only, so these stand for it: no row needs an id
    own = [*keys, "a", "b"]
    rows = left.select(*own).where("a is not null and b is not null").distinct()
    rows = rows.withColumns({"__from": F.col("a"), "__to": F.greatest("a", "b") + 1})
    s = spans.select(*keys, F.col("a").alias("span_a"), F.col("b").alias("span_b")).where("span_a is not null and span_b is not null")
    s = s.withColumns({"__from": F.col("span_a"), "__to": F.greatest("span_a", "span_b") + 1})
    s, rows = (bucketed(within(x, y, keys), "__from", "__to").drop("__from", "__to") for x, y in ((s, rows), (rows, s)))
    on = _same([*keys, "__bucket"]) & (F.col("l.a") < F.col("r.span_b")) & (F.col("l.b") > F.col("r.span_a"))
    found = rows.alias("l").join(s.alias("r"), on, "left_semi").select(*own).distinct()
    return left.alias("l").join(found.alias("r"), _same(own), how)
