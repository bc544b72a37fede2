"""Cutting oversized segments into overlapping pieces at natural boundaries (problem 2).

Everything stays in SQL expressions. One regular expression a row, with the row's own limit as its bounded quantifier,
consumes the text: its alternatives are ordered by the strength of the boundary (sentence, clause, white space) and end
with any character that begins no combining mark, then any character at all. Array functions turn the consumed parts into
offsets, and each piece looks back by the overlap. Time is shared out over the characters, so a limit of time is a limit
of characters too.

Defined results: a null text has no characters; a missing time gives no length (pieces of such a segment have null times);
exactly at a limit is not oversized, and segments within their limits give no row; a segment delivered twice is cut once;
segments of a configuration without limits are not cut. If the time allows less than one character a piece, the text
stays on the first piece while the time is cut into equal parts. Where the room for new text would be under half of the
allowed piece, the overlap shrinks to the other half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks that end a sentence, closers that may follow them, and marks that end a clause.
ENDS, CLOSERS, CLAUSES = "。．｡！？!?…।‥", "」』”’»）)\"'］]", "、，､,;；:：—–"


def boundary_pattern(size: str) -> str:
    """SQL for the pattern whose quantifiers are bounded by the SQL expression ``size``; strongest boundary first."""

    def text(s: str) -> str:
        return s.replace("\\", "\\\\").replace("'", "\\'")

    closers = CLOSERS.replace("]", "\\]").replace("[", "\\[")
    strong = f"(?<=[{ENDS}][{closers}]{{0,3}}\\s{{0,4}}|[.!?][{closers}]{{0,3}}\\s{{1,4}}|\\n{{1,4}})(?![{ENDS}{closers}\\s])"
    weak = [f"(?<=[{CLAUSES}]\\s{{0,4}})(?![{CLAUSES}\\s])", "(?<=\\s)(?!\\s)", "(?![\\p{M}\\u200d\\ufe00-\\ufe0f])", ""]
    parts = [f"concat('.{{1,', {size}, '}}{text(b)}')" for b in (strong, *weak)]
    rest = f"concat('.{{1,', {size}, '}}\\\\z')"
    return "concat('(?s)', concat_ws('|', " + ", ".join([rest, *parts]) + "))"


def pieces(segments: DataFrame, limits: DataFrame) -> DataFrame:
    """(``seg_id``, ``piece``, ``offset``, ``text``, ``start_ms``, ``end_ms``): the pieces of every oversized segment.

    ``segments`` has seg_id, config, start_s, end_s, text; ``limits`` has config, max_chars, max_ms, overlap_chars, one
    row a configuration; it is no larger than the number of configurations. ``offset`` is the number of characters before
    the piece in the text as delivered, from 0; pieces are numbered from 1.
    """
    limits = limits.groupBy("config").agg(F.min("max_chars").alias("__chars"), F.min("max_ms").alias("__ms"), F.min("overlap_chars").alias("__overlap"))
    s = segments.select("seg_id", "config", "text", *(F.round(segments[c] * 1000).cast("bigint").alias(n) for c, n in (("start_s", "__a"), ("end_s", "__b"))))
    s = s.join(limits, "config").withColumn("__n", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).withColumn("__t", F.expr("__b - __a"))
    s = s.where("__n > __chars or __t > __ms").dropDuplicates(["seg_id"])
    # the most characters of a piece, by both limits; 0 where time is shorter than one character
    s = s.withColumn("__most", F.expr("case when __t > __ms then least(__chars, __ms * __n div __t) else __chars end"))
    s = s.withColumn("__back", F.expr("least(coalesce(__overlap, 0), __most div 2)")).withColumn("__step", F.expr("__most - __back"))
    s = s.withColumn("__parts", F.expr(f"case when __n > 0 and __step > 0 then regexp_extract_all(text, {boundary_pattern('__step')}, 0) else array() end"))
    s = s.withColumn("__even", F.expr("__step < 1 or __n = 0"))
    # the look-back of every part: the end of the part before, or of as many parts as the overlap has characters
    near = "case when i = 0 or __back = 0 then '' when char_length(__parts[i - 1]) >= __back then right(__parts[i - 1], cast(__back as int))"
    far = "right(array_join(slice(__parts, cast(greatest(i - __back, 0L) as int) + 1, cast(least(i, __back) as int)), ''), cast(__back as int)) end"
    parts = F.expr(f"transform(__parts, (p, i) -> named_struct('back', {near} else {far}, 'new', p))")
    even = F.expr("transform(sequence(1, cast(ceil(__t / __ms) as int)), i -> named_struct('back', '', 'new', case when i = 1 then text else substring(text, 1, 0) end))")
    s = s.select("seg_id", "__a", "__t", "__ms", "__n", "__even", F.posexplode(F.when(F.col("__even"), even).otherwise(parts)).alias("i", "x"))
    upto = Window.partitionBy("seg_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("piece", F.col("i") + 1).withColumn("__end", F.sum(F.coalesce(F.char_length("x.new"), F.lit(0))).over(upto).cast("bigint"))
    s = s.withColumn("offset", F.expr("__end - coalesce(char_length(x.new), 0) - char_length(x.back)"))
    share = "__a + (case when __even then (piece - {0}) * __t div cast(ceil(__t / __ms) as int) else {1} * __t div __n end)"
    return s.select(
        "seg_id",
        "piece",
        "offset",
        F.expr("case when x.new is not null then concat(x.back, x.new) end").alias("text"),
        F.expr(share.format(1, "offset")).alias("start_ms"),
        F.expr(share.format(0, "__end")).alias("end_ms"),
    )
